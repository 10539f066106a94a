"""Vectorised pre-tokenisation for byte-level BPE, with a bounded cache of encoded pieces.

Texts are split exactly as the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
splits them. Documents with a special token's string, or with a character outside
the table of well-known ones, go whole to the backend's own path.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from bitempo.llm import hashing as H

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Characters split in one go.
BLOCK = 1 << 19


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each character below U+0250 and in General Punctuation; the rest is UNKNOWN."""
    out = np.full(0x110000, UNKNOWN, np.uint8)
    for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC, 0x2122, 0x2026]:
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    return out


def split(cps: np.ndarray, firsts: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Sorted starts of the pieces; firsts holds the start of each (non-empty) text, kind the class of each character."""
    n = len(cps)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[firsts] = True
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    run = np.flatnonzero(new)
    end = np.append(run[1:], n)
    space = kind[run] == SPACE
    last = first[end]  # the run ends its text
    begins = np.zeros(n + 1, bool)
    begins[run[space]] = True
    begins[end[space & ~last] - 1] = True
    word = run[~space]
    attached = ~first[word] & (cps[word - 1] == 32)
    begins[word[~attached]] = True
    # contractions: a lone apostrophe that starts a piece and has letters behind it
    at = np.flatnonzero((kind[run] == OTHER) & (end - run == 1) & (cps[run] == 39) & ~last)
    if len(at):
        at = at[begins[run[at]] & (kind[end[at]] == LETTER)]
        s, stop = end[at], end[at + 1] if len(at) else end[at]
        a = cps[s]
        b = np.where(s + 1 < stop, cps[np.minimum(s + 1, n - 1)], 0)
        size = np.where(np.isin(a, [115, 116, 109, 100]), 1, 0)
        size = np.where(((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108), 2, size)
        hit = size > 0
        begins[s[hit]] = False
        begins[(s + size)[hit]] = True
    return np.flatnonzero(begins[:n])


def roomy(x: np.ndarray, n: int) -> np.ndarray:
    """The array, or one of twice the size or more with room for n."""
    if n <= len(x):
        return x
    out = np.zeros(max(2 * len(x), n), x.dtype)
    out[: len(x)] = x
    return out


class Encoder:
    """Ids of texts. backend.pieces(list of str) encodes pieces, backend.whole(str) any text."""

    def __init__(self, backend, capacity: int = 1_500_000):
        self.backend, self.capacity = backend, capacity
        self.clear()

    def clear(self) -> None:
        # entry i has pool[first[i]:first[i + 1]]; slots (open addressing) holds the entries by first hash, 0 where free
        self.slots = np.zeros(1 << 12, np.int32)
        self.keys = np.zeros(1 << 11, np.uint64)
        self.check = np.zeros(1 << 11, np.uint64)
        self.first = np.zeros(1 << 11, np.int64)
        self.held = 1
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, 0 for unknown ones."""
        mask = len(self.slots) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        found = self.slots[at]
        going = np.flatnonzero((found > 0) & (self.keys[found] != keys))
        while len(going):
            at[going] = (at[going] + 1) & mask
            found[going] = here = self.slots[at[going]]
            going = going[(here > 0) & (self.keys[here] != keys[going])]
        return found

    def _place(self, entries: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (self.keys[entries] & np.uint64(mask)).astype(np.int64)
        while len(entries):
            free = self.slots[at] == 0
            self.slots[at[free]] = entries[free]
            left = self.slots[at] != entries  # the slot is taken, or another entry has just won it
            entries, at = entries[left], (at[left] + 1) & mask

    def _add(self, keys: np.ndarray, check: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """New entries for new keys, which differ."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        a, b, total = self.held, self.held + len(ids), int(size.sum())
        self.keys, self.check, self.first, self.pool = roomy(self.keys, b), roomy(self.check, b), roomy(self.first, b + 1), roomy(self.pool, self.used + total)
        self.keys[a:b], self.check[a:b] = keys, check
        self.first[a + 1 : b + 1] = self.used + np.cumsum(size)
        self.pool[self.used : self.used + total] = [i for x in ids for i in x]
        self.held, self.used = b, self.used + total
        if 2 * b > len(self.slots):
            self.slots = np.zeros(1 << (2 * b).bit_length(), np.int32)
            self._place(np.arange(1, b, dtype=np.int32))
        else:
            self._place(np.arange(a, b, dtype=np.int32))
        return np.arange(a, b, dtype=np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and offsets: text i has ids[offsets[i]:offsets[i + 1]]."""
        parts, sizes, group, held = [], np.zeros(len(texts), np.int64), [], 0
        order = []

        def flush():
            nonlocal group, held
            if group:
                for (i, _), ids in zip(group, self._block([t for _, t in group]), strict=True):
                    order.append(i)
                    parts.append(ids)
                    sizes[i] += len(ids)
            group, held = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            for part in cut(text, BLOCK, self.backend.special):
                if held + len(part) > BLOCK:
                    flush()
                group.append((i, part))
                held += len(part)
        flush()
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), offsets

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        firsts, begins, stop, ids, odd = self._pieces(texts)
        bounds = np.append(np.searchsorted(begins, firsts), len(begins))
        cuts = np.concatenate([[0], stop])[bounds]
        return [np.asarray(self.backend.whole(t), np.int32) if bad else ids[a:b] for t, bad, a, b in zip(texts, odd.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def traced(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each piece, number of ids before each piece) of one text."""
        if not text:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, begins, stop, ids, odd = self._pieces([text])
        return self.backend.traced(text) if odd[0] else (ids, begins, np.concatenate([[0], stop[:-1]]))

    def _pieces(self, texts: list[str]):
        """(start of each text, start of each piece, number of ids up to each piece's end, ids, whether each text is not to be trusted)."""
        lengths = np.array([len(t) for t in texts], np.int64)
        text = "".join(texts)
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        firsts = np.cumsum(lengths) - lengths
        kind = classes()[cps]
        odd = np.add.reduceat((kind == UNKNOWN).astype(np.int64), firsts) > 0
        for s in self.backend.special:
            if s in text:
                odd |= np.array([s in t for t in texts])
        begins = split(cps, firsts, kind)
        ends = np.append(begins[1:], len(cps))
        size = (ends - begins).astype(np.uint64)
        wide = cps.astype(np.uint64) + np.uint64(1)  # so that U+0000 counts
        h1 = H.mix(H.pieces(wide, begins) + size)
        h2 = H.mix(H.pieces(wide, begins, H.POWERS2) ^ size)
        found = self._find(h1)
        new = np.flatnonzero(found == 0)
        if len(new):
            keys, at, inverse = np.unique(h1[new], return_index=True, return_inverse=True)
            if self.held > 1 and self.held + len(keys) > self.capacity:
                self.clear()
                new = np.arange(len(h1))
                keys, at, inverse = np.unique(h1, return_index=True, return_inverse=True)
            at = new[at]
            a, b = begins[at].tolist(), ends[at].tolist()
            found[new] = self._add(keys, h2[at], self.backend.pieces([text[x:y] for x, y in zip(a, b, strict=True)]))[inverse]
        clash = self.check[found] != h2  # two pieces with the same first hash
        where = self.first[found]
        n = self.first[found + 1] - where
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(where - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        if clash.any():
            odd |= np.add.reduceat(clash.astype(np.int64), np.searchsorted(begins, firsts)) > 0
        return firsts, begins, stop, ids, odd


def safe_boundaries(text: str, start: int, stop: int):
    """Offsets in (start, stop) before a blank that follows a non-blank and precedes another: a piece ends there in any context, and no special token spans a blank."""
    at = text.find(" ", start + 1, stop)
    while at >= 0:
        if not text[at - 1].isspace() and at + 1 < len(text) and not text[at + 1].isspace():
            yield at
        at = text.find(" ", at + 1, stop)


def cut(text: str, limit: int, special=()) -> list[str]:
    """The text in parts of about limit characters, cut only at safe boundaries; looks further ahead where there is none."""
    if len(text) <= limit:
        return [text]
    out, a = [], 0
    while len(text) - a > limit:
        wide, at, stop = 4096, None, a + limit
        while at is None and stop < len(text):
            stop = min(len(text), a + limit + wide)
            at = next(safe_boundaries(text, a + limit - 1, stop), None)
            wide *= 4
        if at is None:
            break
        out.append(text[a:at])
        a = at
    return [*out, text[a:]]
