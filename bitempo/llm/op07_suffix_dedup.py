"""Operator 7: removal of repeated byte strings by hash-compared suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts in a document
with a smaller key. All of it is judged on the input.

1. Texts are packed into blocks. In each window of ``length`` bytes the ``gram``-byte
   strings with the least hash are its anchors, so equal windows have equal anchors
   at equal places. Blocks exchange anchor hashes; only anchors found in two
   documents go on.
2. Each block sends, once per distinct context, the bytes around these anchors to the
   task of the anchor's hash. There the windows' suffixes are sorted with hash
   comparisons and mergesort, equal neighbours are verified byte by byte, and each
   class of equal windows gets its smallest key. An anchor found in more than ``hot``
   documents sends single windows instead, dealt out by the window's own hash, so no
   task gets more than one row per block for any string.
3. Blocks get back which windows have an earlier copy and mark the bytes covered.

Nulls and empty texts have nothing to remove. Rows with equal keys do not remove each
other's bytes, but lose what starts in a smaller key's. A null key counts as larger
than all others. Very long texts are a block of their own. Extra columns are kept, but
for those named like a result's; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitempo.llm import blocks as B
from bitempo.llm import hashing as H
from bitempo.llm.spaces import shared_folder, tidied
from bitempo.llm.suffixes import Suffixes

#: Window starts handled at a time: their arrays stay in a core's cache.
STEP = 1 << 16
LAST = np.iinfo(np.int64).max
RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window of width neighbours."""
    w = 1
    while 2 * w <= width:
        x = f(x[:-w], x[w:])
        w *= 2
    return f(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


class Shape:
    """Window length (at most 127), anchor length and what follows from them."""

    def __init__(self, length: int, gram: int):
        if not 0 < length - gram < 32 or length > 127:
            raise ValueError("a window must have 2 to 32 anchors to choose from and at most 127 bytes")
        self.length, self.gram = length, gram
        self.w = length - gram + 1  # anchors to choose from in a window; at most 32, so that a mask fits 32 bits
        self.before = self.w - 1
        self.wide = self.before + length


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows that lie within a document."""
    n, out = len(data), []
    edge = np.zeros(n + 1, np.int8)
    some = ends > starts
    np.add.at(edge, np.maximum(starts, ends - shape.length + 1)[some], 1)
    np.add.at(edge, ends[some], -1)
    valid = (np.cumsum(edge, dtype=np.int8) == 0)[:n]
    for a in range(0, n, STEP):
        b = min(a + STEP, n - shape.length + 1)
        if b <= a:
            break
        ok = valid[a:b]
        if not ok.any():
            continue
        part = data[a : b + shape.length - 1]
        s = H.prefix(part)
        m = len(part) - shape.gram + 1
        h = (s[shape.gram :] - s[:m]) * H.POWERS.get(len(s))[1][:m]
        rank = np.maximum((h * H.BASE2) >> np.uint64(32), np.uint64(1)).astype(np.uint32)
        least = slide(rank, shape.w, np.minimum)
        least[~ok] = 0
        pad = np.zeros(shape.before, np.uint32)
        at = np.flatnonzero(slide(np.concatenate([pad, least, pad]), shape.w, np.maximum) == rank)
        out.append((at + a, H.mix(h[at])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, h = (np.concatenate(x) for x in zip(*out, strict=True))
    pos, new = np.unique(pos, return_index=True)
    return pos, h[new]


class Block:
    """A block's texts with their anchors, the same each time it is read."""

    def __init__(self, table: pa.Table, key: str, text: str, shape: Shape):
        self.table, self.shape = table, shape
        self.data, self.starts, self.ends = B.strings(table, text)
        keys = table.column(key).cast(pa.int64())
        self.keys = np.asarray(pc.fill_null(keys, LAST), np.int64)
        self.pos, self.h = anchors(self.data, self.starts, self.ends, shape)
        self.doc = np.searchsorted(self.ends, self.pos, side="right")
        self.distinct, self.number = np.unique(self.h, return_inverse=True)

    def masks(self, some: np.ndarray) -> np.ndarray:
        """Bit j: the window j bytes before the anchor is within its document."""
        most = np.minimum(self.pos[some] - self.starts[self.doc[some]], self.shape.before)
        least = np.maximum(0, self.pos[some] + self.shape.length - self.ends[self.doc[some]])
        one = np.uint64(1)
        return (((one << (most + 1).astype(np.uint64)) - one) & ~((one << least.astype(np.uint64)) - one)).astype(np.uint32)

    def contexts(self, place: np.ndarray, doc: np.ndarray, out: np.ndarray) -> None:
        """Fill out with the bytes around each place; zeros outside its document."""
        gap, n = self.shape.wide, len(self.starts)
        padded = np.zeros(len(self.data) + gap * (n + 2), np.uint8)
        shift = gap * (np.arange(n) + 1)
        for a, b, c in zip(self.starts.tolist(), self.ends.tolist(), shift.tolist(), strict=True):
            padded[a + c : b + c] = self.data[a:b]
        around = np.lib.stride_tricks.sliding_window_view(padded, gap)
        for a in range(0, len(place), STEP):
            some = slice(a, a + STEP)
            out[some] = around[place[some] + shift[doc[some]] - self.shape.before]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct anchor hashes, and the number of documents with each."""
        _, doc = np.unique(self.number * len(self.starts) + self.doc, return_index=True)
        return self.distinct, np.bincount(self.number[doc], minlength=len(self.distinct))

    def entries(self, totals: np.ndarray, hot: int):
        """(occurrences, entries). An occurrence is (place of the context, document, entry); entries ascend by hash and have (hash, mask, first document, context)."""
        total = totals[self.number] if len(self.h) else np.zeros(0, np.int64)
        some, many = np.flatnonzero((total >= 2) & (total <= hot)), np.flatnonzero(total > hot)
        place, doc, h, mask = self.pos[some], self.doc[some], self.h[some], self.masks(some)
        before, wide, length = self.shape.before, self.shape.wide, self.shape.length
        if len(many):
            row, j = np.nonzero((self.masks(many)[:, None] >> np.arange(self.shape.w, dtype=np.uint32)) & 1)
            start, at = np.unique(self.pos[many][row] - j, return_index=True)
            place = np.concatenate([place, start + before])
            doc = np.concatenate([doc, self.doc[many][row[at]]])
            h = np.concatenate([h, np.zeros(len(start), np.uint64)])
            mask = np.concatenate([mask, np.full(len(start), 1 << before, np.uint32)])
        if not len(place):
            empty = np.zeros(0, np.int64)
            return (empty, empty, empty), (h, mask, empty, np.zeros((0, wide), np.uint8))
        words = np.zeros((len(place), -(-wide // 8) * 8), np.uint8)
        self.contexts(place, doc, words[:, :wide])
        words[len(some) :, length:] = 0
        context = words[:, :wide]
        words = words.view("<u8")
        sums = H.mix(mask.astype(np.uint64))
        for c in range(words.shape[1]):
            sums = H.mix(sums + words[:, c] * np.uint64(2 * c + 3))
        h[len(some) :] = H.mix(sums[len(some) :])
        order = np.lexsort((sums, h))  # stable: documents ascend within an entry
        new = np.ones(len(order), bool)
        for a in range(1, len(order), STEP):
            o, p = order[a : a + STEP], order[a - 1 : a + STEP - 1][: len(order) - a]
            new[a : a + STEP] = (h[o] != h[p]) | (mask[o] != mask[p]) | (words[o] != words[p]).any(axis=1)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        first = order[new]
        return (place, doc, entry), (h[first], mask[first], doc[first], context[first])


def send_entries(block: Block, totals: np.ndarray, hot: int, parts: int):
    _, (h, mask, doc, context) = block.entries(totals, hot)
    bounds = B.ranges(h, parts)
    z = zstandard.ZstdCompressor(level=1)
    for p in range(parts):
        a, b = int(bounds[p]), int(bounds[p + 1])
        if a == b:
            continue
        raw = h[a:b].tobytes() + mask[a:b].tobytes() + block.keys[doc[a:b]].tobytes() + context[a:b].tobytes()
        yield p, b - a, z.compress(raw)


def resolve(rows: list[dict], shape: Shape, block: int = 1 << 14) -> list[bytes]:
    """For each row's entries, the windows that also start in a document with a smaller key, as masks."""
    cuts = np.cumsum([0, *(r["n"] for r in rows)])
    h, mask, key, context = np.empty(cuts[-1], np.uint64), np.empty(cuts[-1], np.uint32), np.empty(cuts[-1], np.int64), np.empty((cuts[-1], shape.wide), np.uint8)
    for r, a, b in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # one row's entries unpacked at a time
        n, raw = r["n"], zstandard.ZstdDecompressor().decompress(r.pop("entries"))
        h[a:b], mask[a:b], key[a:b] = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n), np.frombuffer(raw, np.int64, n, 12 * n)
        context[a:b] = np.frombuffer(raw, np.uint8, n * shape.wide, 20 * n).reshape(n, shape.wide)
    found = np.zeros(len(h), np.uint32)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    size = np.bincount(group) if len(s) else np.zeros(0, np.int64)
    keep = size[group] > 1 if len(s) else np.zeros(0, bool)
    order, group = order[keep], group[keep]
    a = 0
    while a < len(order):  # whole groups, about `block` entries at a time
        b = int(np.searchsorted(group, group[min(a + block, len(order)) - 1], side="right"))
        idx = order[a:b]
        found[idx] = earlier(context[idx], group[a:b], mask[idx], key[idx], shape)
        a = b
    z = zstandard.ZstdCompressor(level=1)
    return [z.compress(x.tobytes()) if len(x) else b"" for x in np.split(found, cuts[1:-1])]


def extents(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, string), and each one's verified common prefix with the one before it in its group (-1 for a group's first)."""
    n, cap = rows.shape
    order, same = Suffixes(np.ascontiguousarray(rows).ravel()).sort(np.arange(n) * cap, group, cap)
    unlike = rows[order[1:]] != rows[order[:-1]]
    real = np.where(unlike.any(axis=1), unlike.argmax(axis=1), cap)
    return order, np.concatenate([same[:1], np.where(same[1:] < 0, -1, np.minimum(same[1:], real))])


def earlier(context: np.ndarray, group: np.ndarray, mask: np.ndarray, key: np.ndarray, shape: Shape) -> np.ndarray:
    """Masks of the windows that a smaller key's entry of the same group has too.

    One suffix of each context starts at its anchor and one, reversed, ends there. In
    the sorted order, suffixes agree in their first m bytes as long as the common
    extensions of neighbours are m or more; a window is an agreement of both.
    """
    n = len(context)
    ahead, common = extents(context[:, shape.before :], group)
    behind, shared = extents(context[:, : shape.before][:, ::-1], group)
    found = np.zeros(n, np.uint32)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(shape.w):
        on = np.flatnonzero((mask >> np.uint32(j)) & 1)
        if not len(on):
            continue
        right[ahead] = np.cumsum(common < shape.length - j)
        left[behind] = np.cumsum(shared < j)
        _, window = np.unique(left[on] * (n + 1) + right[on], return_inverse=True)
        least = np.full(len(on), LAST, np.int64)
        np.minimum.at(least, window, key[on])
        found[on] |= (least[window] < key[on]).astype(np.uint32) << np.uint32(j)
    return found


def covered(block: Block, totals: np.ndarray, masks: np.ndarray, hot: int) -> np.ndarray:
    """Whether each byte of the block goes."""
    (place, doc, entry), (_, mask, first, _) = block.entries(totals, hot)
    later = block.keys[doc] > block.keys[first[entry]]
    bits = np.where(later, mask[entry], masks[entry])
    n = len(block.data)
    start = np.zeros(n + 1, np.int8)
    for j in range(block.shape.w):
        start[place[(bits >> np.uint32(j)) & 1 > 0] - j] = 1
    edge = start.copy()  # no more windows than their length cover a byte
    edge[block.shape.length :] -= start[: -block.shape.length]
    return np.cumsum(edge[:n], dtype=np.int8) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, gram: int = 28, hot: int = 1024, texts: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_sha256; with texts, the column text holds what is kept (bytes that no longer form a character go too), else it goes with all columns but the key."""
    spark = docs.sparkSession
    shape = Shape(length, gram)
    folder = shared_folder(spark)
    if not texts:
        docs = docs.select(key, text)
    blocks = B.pack(docs, f"{folder}/blocks", key, text)
    parts, _ = B.scale(blocks)
    totals = B.shared_counts(blocks, lambda t: Block(t, key, text, shape).hashes(), f"{folder}/anchors")

    def entries(block: int, raw, answers) -> pa.RecordBatch:
        rows = list(send_entries(Block(B.from_ipc(raw.as_buffer()), key, text, shape), B.counts_of(answers.as_py() or []), hot, parts))
        return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["block", "part", "n", "entries"])

    def send(batches):
        for b in batches:
            for block, raw, answers in zip(b.column(0).to_pylist(), *b.columns[1:], strict=True):
                yield entries(block, raw, answers)  # a block's arrays are gone when the next one is read

    sent = B.with_answers(blocks, totals).mapInArrow(tidied(send), "block long, part int, n long, entries binary")
    masks = B.exchange(sent, lambda rows: resolve(rows, shape), f"{folder}/windows")

    kept = [f for f in docs.schema.fields if f.name in (key, text) or f.name not in RESULT]
    kept = kept if texts else [f for f in kept if f.name == key]
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in kept] + [T.StructField(c, T.LongType()) for c in RESULT[:3]] + [T.StructField(RESULT[3], T.StringType())])

    def kept_rows(raw, a0, a1) -> pa.RecordBatch:
        block = Block(B.from_ipc(raw.as_buffer()), key, text, shape)
        got = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x["reply"]), np.uint32) for x in sorted(a1.as_py() or [], key=lambda x: x["part"]) if x["reply"]]
        gone = covered(block, B.counts_of(a0.as_py() or []), np.concatenate(got) if got else np.zeros(0, np.uint32), hot)
        return digest(block, gone, [f.name for f in kept], text if texts else None)

    def finish(batches):
        for b in batches:
            for raw, a0, a1 in zip(*b.columns[1:], strict=True):
                yield kept_rows(raw, a0, a1)

    return B.with_answers(blocks, totals, masks).mapInArrow(tidied(finish), schema)


def digest(block: Block, gone: np.ndarray, columns: list[str], text: str | None) -> pa.RecordBatch:
    """A row for each document of the block."""
    stay, hashes, counts = [], [], np.zeros((2, len(block.starts)), np.int64)
    for i, (a, b) in enumerate(zip(block.starts.tolist(), block.ends.tolist(), strict=True)):
        raw, some = block.data[a:b], gone[a:b]
        if n := np.count_nonzero(some):
            counts[:, i] = n, np.count_nonzero(some[1:] & ~some[:-1]) + some[0]
            raw = raw[~some]
        raw = raw.tobytes()
        hashes.append(hashlib.sha256(raw).hexdigest())
        if text:
            stay.append(raw.decode("utf-8", "ignore").encode() if n else raw)
    t = block.table
    out = [pa.array(stay, pa.string()) if c == text else t.column(c).combine_chunks() for c in columns]
    out = [x.chunk(0) if isinstance(x, pa.ChunkedArray) and x.num_chunks else x for x in out]
    out += [pa.array(block.ends - block.starts), pa.array(counts[0]), pa.array(counts[1]), pa.array(hashes, pa.string())]
    return pa.RecordBatch.from_arrays(out, [*columns, *RESULT])
