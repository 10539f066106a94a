"""Blocks of rows, and the exchange of hash sets between them.

A table is packed once, without a shuffle, into blocks of bounded size (one binary
row each). Operators that ask "which of my hashes occur elsewhere?" send, from each
block, its sorted distinct hashes as one delta-coded row per hash range, and get back
one small answer row. A hash, however common, is sent once per block, so common
hashes cannot fill a task. There are as many ranges as the blocks' bytes ask for, so a
range has the same size whatever the table's; a block sends nothing to a range that it
has no hash of, so there are never more rows than hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.llm import hashing as H
from bitempo.llm.spaces import partitions, through, tidied, tidy

#: Bytes of text in a block, unless one row alone is longer.
BLOCK_BYTES = 5 << 20
#: Bytes of text whose hashes make a range.
RANGE_BYTES = 12 << 20
BLOCKS = "block long, n_rows long, n_bytes long, rows binary"


def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def pack(df: DataFrame, path: str, key: str, text: str, size: int = BLOCK_BYTES) -> DataFrame:
    """Write df as blocks at path; rows of a block ascend by key, nulls last. The block table, read back.

    It is bucketed by block, so what joins answers to blocks shuffles the answers alone.
    The catalog forgets it at once; its files stay for as long as the caller leaves them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, lengths, seq = TaskContext.get().partitionId(), [], 0, 0

        def out():
            nonlocal held, lengths, seq
            t = pa.concat_tables(held).sort_by([(key, "ascending")])
            row = pa.RecordBatch.from_arrays([pa.array([part << 24 | seq]), pa.array([t.num_rows]), pa.array([lengths]), pa.array([to_ipc(t)], pa.binary())], ["block", "n_rows", "n_bytes", "rows"])
            held, lengths, seq = [], 0, seq + 1
            return row

        for b in batches:
            t = pa.Table.from_batches([b])
            n = np.asarray(pc.fill_null(pc.binary_length(t.column(text)), 0)).astype(np.int64)
            ends, at = np.cumsum(n), 0
            while at < t.num_rows:
                base = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, base + size - lengths, side="right")))
                if held and lengths + ends[stop - 1] - base > size:
                    yield out()
                    continue
                held.append(t.slice(at, stop - at))
                lengths += int(ends[stop - 1] - base)
                at = stop
                if lengths >= size:
                    yield out()
        if held:
            yield out()

    spark = df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    packed = df.withColumn(text, F.col(text).cast("string")).mapInArrow(tidied(run), BLOCKS)
    packed.write.option("path", path).bucketBy(partitions(spark), "block").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    return out


def scale(blocks: DataFrame) -> tuple[int, int]:
    """(ranges, bits of a hash) that an exchange between the blocks needs: at most one false agreement in 2**18 entries; 64 bits for the largest inputs."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 1
    return max(partitions(blocks.sparkSession), -(-total // RANGE_BYTES)), min(64, max(40, math.ceil(math.log2(total + 1)) + 18))


def squeeze(values: np.ndarray) -> bytes:
    """Ascending uint64 values as byte planes of their differences."""
    d = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(d.tobytes())


def spread(raw: bytes) -> np.ndarray:
    d = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(d).view("<u8").ravel(), dtype=np.uint64)


def ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the hash ranges 0..parts-1 in ascending hashes."""
    edges = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def exchange(sent: DataFrame, answer: Callable, path: str) -> DataFrame:
    """One row (block, answers array<struct<part, reply>>) per block, written at path.

    sent: (block, part, + binary columns). answer gets, for one part, the list of
    blocks' rows as dicts and returns one reply (bytes) per row, in that order.
    """

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by([("block", "ascending")]).to_pylist()
        out = {"block": pa.array([r["block"] for r in rows], pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int32())}
        out["reply"] = pa.array(answer(rows), pa.binary())
        del rows
        tidy()
        return pa.table(out)

    replies = sent.groupBy("part").applyInArrow(run, "block long, part int, reply binary")
    return through(replies.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "reply"))).alias("answers")), path)


def send_hashes(hashes: np.ndarray, counts: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, squeezed hashes, counts) for each hash range that has some of the ascending distinct hashes; counts saturate at 255."""
    top = hashes >> np.uint64(64 - bits)
    bounds = ranges(hashes, parts)
    small = np.minimum(counts, 255).astype(np.uint8)
    for p in range(parts):
        a, b = bounds[p], bounds[p + 1]
        if a < b:
            yield p, squeeze(top[a:b]), zstandard.ZstdCompressor(level=1).compress(small[a:b].tobytes())


HASHES = "block long, part int, hashes binary, counts binary"


def total_counts(rows: list[dict]) -> list[bytes]:
    """For each row's hashes, the sum of all rows' counts (saturating at 65535), as uint16."""
    values = [spread(r["hashes"]) for r in rows]
    counts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.uint8) if len(v) else np.zeros(0, np.uint8) for r, v in zip(rows, values, strict=True)]
    v, c = np.concatenate(values), np.concatenate(counts).astype(np.int64)
    if not len(v):
        return [b"" for _ in rows]
    order = np.argsort(v, kind="stable")
    s = v[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    group = np.cumsum(new) - 1
    total = np.minimum(np.bincount(group, weights=c[order]), 65535).astype(np.uint16)
    out = np.empty(len(v), np.uint16)
    out[order] = total[group]
    cuts = np.cumsum([len(x) for x in values])[:-1]
    return [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) if len(x) else b"" for x in np.split(out, cuts)]


def counts_of(answers: list[dict]) -> np.ndarray:
    """The totals of a block's ascending hashes from its answers."""
    parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(a["reply"]), np.uint16) for a in sorted(answers, key=lambda a: a["part"]) if a["reply"]]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def shared_counts(blocks: DataFrame, hashes_of: Callable, path: str, *answers: DataFrame) -> DataFrame:
    """For each block, how often each of its distinct hashes occurs in all blocks. hashes_of(table, answers...) gives (ascending distinct hashes, their counts in the block); answers are a block's rows of earlier exchanges."""
    parts, bits = scale(blocks)

    def hashed(block: int, raw, told) -> pa.RecordBatch:
        h, c = hashes_of(from_ipc(raw.as_buffer()), *(x.as_py() or [] for x in told))
        rows = list(send_hashes(h, c, bits, parts))
        return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["block", "part", "hashes", "counts"])

    def send(batches):
        for b in batches:
            for block, raw, *told in zip(b.column(0).to_pylist(), *b.columns[1:], strict=True):
                yield hashed(block, raw, told)  # a block's arrays are gone when the next one is read

    return exchange(with_answers(blocks, *answers).mapInArrow(tidied(send), HASHES), total_counts, path)


def with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """blocks with each answer table's column, as answers0, answers1, ..."""
    out = blocks.select("block", "rows")
    for i, a in enumerate(answers):
        out = out.join(a.select("block", F.col("answers").alias(f"answers{i}")), "block", "left")
    return out


def strings(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column's bytes, and each row's start and end in them; nulls are empty."""
    a = pc.fill_null(table.column(column).cast(pa.large_string()), "").combine_chunks()
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    raw = raw[off[0] : off[-1]]
    off = off - off[0]
    return raw, off[:-1], off[1:]


#: Bytes hashed at a time: their arrays stay in a core's cache.
STEP = 1 << 17
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of the texts: maximal runs of bytes other than blank and tab to carriage return, A-Z in lower case."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    solid = ~BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[n] = True
    begin = solid & edge[:n]
    begin[1:] |= solid[1:] & ~solid[:-1]
    stop = solid & edge[1:]
    stop[:-1] |= solid[:-1] & ~solid[1:]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    out = np.empty(len(a), np.uint64)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(a, a[i] + STEP)))
        base = a[i]
        s = H.prefix(LOWER[data[base : b[j - 1]]])
        out[i:j] = H.mix(H.spans(s, a[i:j] - base, b[i:j] - base) + (b[i:j] - a[i:j]).astype(np.uint64) * H.BASE2)
        i = j
    return a, b, out
