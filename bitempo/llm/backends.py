"""How pieces and odd texts are encoded: by the heap encoder or by the tokenizers library."""

from __future__ import annotations

import os
import re
from codecs import charmap_decode
from functools import lru_cache
from operator import attrgetter

import numpy as np
import regex

from bitempo.llm.bpe import byte_alphabet, vocabulary
from bitempo.llm.pieces import Encoder

#: The split pattern of byte-level BPE, a fixed value of the file format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ID = attrgetter("id")


class HeapBackend:
    """Operator 1's own encoder."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.special = tuple(self.vocabulary.special)
        self.find = regex.compile(PATTERN).findall
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        encode = self.vocabulary.encode_piece
        return [encode(p.encode()) for p in pieces]

    def whole(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.between.split(text) if self.between else [text]:
            if part in self.vocabulary.special:
                out.append(self.vocabulary.special[part])
            else:
                for piece in self.find(part):
                    out += self.vocabulary.encode_piece(piece.encode())
        return out


class LibraryBackend:
    """The tokenizers library; pieces go to its model as they are, or, where its tokenizer does more than split and merge, many in one call, told apart by the library's word numbers."""

    joined = re.compile(r" ?[^\s]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        before = self.tokenizer.pre_tokenizer
        plain = isinstance(self.tokenizer.model, BPE) and isinstance(before, ByteLevel) and not before.add_prefix_space and self.tokenizer.normalizer is None
        #: The library's merging alone, where nothing but the byte alphabet comes before it.
        self.merge = self.tokenizer.model.tokenize if plain else None
        self.letters = "".join(sorted(byte_alphabet(), key=byte_alphabet().get))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def traced(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each piece, number of ids before each piece), by the library's own offsets."""
        got = self.tokenizer.encode(text, add_special_tokens=False)
        number = np.array([-1 if w is None else w for w in got.word_ids])
        first = np.flatnonzero(np.diff(number, prepend=-2))
        starts = np.array([o[0] for o in got.offsets], np.int64)
        return np.asarray(got.ids, np.int32), starts[first], first

    def pieces(self, pieces: list[str], block: int = 2000) -> list[list[int]]:
        if self.merge:
            merge, letters = self.merge, self.letters
            return [list(map(ID, merge(charmap_decode(p.encode(), "strict", letters)[0]))) for p in pieces]
        out: list[list[int]] = []
        for a in range(0, len(pieces), block):
            out += self._some(pieces[a : a + block])
        return out

    def _some(self, pieces: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(pieces)
        words, owner = [], []
        for i, p in enumerate(pieces):
            if self.joined.fullmatch(p):
                if p[0] != " ":
                    words.append("\n")
                    owner.append(-1)
                words.append(p)
                owner.append(i)
        if words:
            got = self.tokenizer.encode("".join(words), add_special_tokens=False)
            number = np.array(got.word_ids, dtype=np.float64)
            cuts = np.flatnonzero(np.diff(number, prepend=-1, append=np.inf))
            if len(cuts) == len(words) + 1 and not np.isnan(number).any():
                ids, c = got.ids, cuts.tolist()
                for k, i in enumerate(owner):
                    if i >= 0:
                        out[i] = ids[c[k] : c[k + 1]]
        return [x if x is not None else self.whole(p) for p, x in zip(pieces, out, strict=True)]


@lru_cache(maxsize=2)
def encoder(kind: str, path: str) -> Encoder:
    """One encoder, with its cache, for each Python worker."""
    return Encoder({"heap": HeapBackend, "library": LibraryBackend}[kind](path))
