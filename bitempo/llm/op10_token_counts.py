"""Operator 10: token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than ``chunk`` characters is encoded in overlapping chunks, each with
the offsets where its pieces (the pre-tokeniser's matches, which no token crosses)
start. Two neighbours are spliced at a piece's start that both found in their overlap.
It is proven stable: up to it the left chunk's pieces are the text's own, since a match
looks at most one character beyond itself, and the boundary stands further than that,
and than any special token is long, before the chunk's end; from it on the right
chunk's are, since a match depends only on what follows its start. Where the overlap
holds none, it is widened; where all of the chunk is overlap, the chunk is doubled, so
a text without any boundary takes time in proportion to its length.

Null counts as empty: 0 bytes, 0 tokens. A key may be null or repeated, and repeated
rows give repeated results. Extra columns are ignored; an empty table gives an empty
result. No shuffle.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.llm.backends import encoder
from bitempo.llm.op01_bpe import blocks
from bitempo.llm.spaces import tidied


class Chunk:
    """The ids of text[start:stop], with the offsets in the text at which its pieces start."""

    def __init__(self, e, text: str, start: int, stop: int):
        self.start, self.stop, self.size = start, stop, len(text)
        self.ids, at, self.before = e.traced(text[start:stop])
        self.at = (at + start).tolist()
        self.margin = max([2, *map(len, e.backend.special)])

    def stable(self, low: int, high: int) -> set[int]:
        """Piece starts in [low, high) that neither of the chunk's ends can have changed."""
        low = max(low, self.start + self.margin if self.start else 0)
        high = min(high, self.stop - self.margin + 1 if self.stop < self.size else self.size)
        return set(self.at[bisect.bisect_left(self.at, low) : bisect.bisect_left(self.at, high)])

    def tokens(self, low: int, high: int) -> np.ndarray:
        a, b = (int(self.before[i]) if i < len(self.at) else len(self.ids) for i in (bisect.bisect_left(self.at, low), bisect.bisect_left(self.at, high)))
        return self.ids[a:b]


def encode_huge(e, text: str, chunk: int, overlap: int) -> np.ndarray:
    """Ids of the text from overlapping chunks spliced at common stable boundaries."""
    out, done, size = [], 0, chunk
    left = Chunk(e, text, 0, min(len(text), size))
    while left.stop < len(text):
        wide = overlap
        while True:
            start = max(done, left.stop - wide)
            right = Chunk(e, text, start, min(len(text), left.stop + chunk))
            common = sorted(left.stable(start + 1, left.stop) & right.stable(start + 1, left.stop))
            if common:
                at = common[len(common) // 2]
                out.append(left.tokens(done, at))
                done, left, size = at, right, chunk
                break
            if start == done:  # the overlap is all of the chunk
                size *= 2
                left = Chunk(e, text, done, min(len(text), done + size))
                break
            wide *= 4
    out.append(left.tokens(done, len(text)))
    return np.concatenate(out)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk: int = 1 << 14, overlap: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row."""

    def run(batches):
        e = encoder("library", path)
        for b in batches:
            for at, part in blocks(b.column(1).to_pylist()):
                huge = [len(t) > chunk for t in part]
                _, off = e.encode(["" if h else t for t, h in zip(part, huge, strict=True)])
                n = np.diff(off)
                for i, h in enumerate(huge):
                    if h:
                        n[i] = len(encode_huge(e, part[i], chunk, overlap))
                size = [len(t.encode()) for t in part]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text).cast("string")).mapInArrow(tidied(run), f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
