"""Operator 3: token ids in binary files, one zstandard frame per document.

File layout (little endian):

    head     b"BTOK", u32 version, u32 bytes per id, u64 dictionary hash
    frames   zstandard frames of the ids, each with the shared dictionary
    index    per document: i64 key, u8 key is null, u64 frame offset, u32 frame size, u64 ids
    foot     u64 index offset, u64 documents, u64 part, u64 number in the part, b"KOTB"

A newline, which no offset counts as content, ends a file, because the files are
written by Spark's own writer. The dictionary is trained on the serialized ids of a
bounded sample (``samples`` different texts of at most ``sample_chars`` characters) and
stored beside the files; readers check its hash. Where the sample is too small to train
on, the dictionary is empty and frames stand alone. A part is one range of keys (a key
with very many rows has several parts); it is cut into files of ``file_bytes`` bytes, however much text falls into it (a document
that is longer has a file of its own). Files and the documents in them ascend by key.

Nulls and empty texts are a document of the end id alone; very long texts are one frame
like others. A null key comes first. Rows that share a key, repeated rows among them,
are written one after the other. Extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitempo.llm.backends import encoder
from bitempo.llm.op01_bpe import blocks
from bitempo.llm.spaces import bounded_sample, drop, partitions, shared_folder, through, tidied

HEAD, FOOT = "<4sIIQ", "<QQQQ4s"
INDEX = np.dtype([("key", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("ids", "<u8")])
VERSION = 2
#: Characters encoded at a time: a worker holds some hundred bytes for each.
STEP = 1 << 18


def width(path: str) -> int:
    return 2 if len(encoder("library", path).backend.tokenizer.get_vocab(with_added_tokens=True)) <= 1 << 16 else 4


def serialize(ids: np.ndarray, size: int) -> bytes:
    return ids.astype(f"<u{size}").tobytes()


def train(docs: DataFrame, path: str, text: str, end_id: int, samples: int, sample_chars: int, dict_bytes: int) -> bytes:
    """A dictionary from a bounded sample of documents, the same for the same table; empty where there is too little to train on."""
    rows = bounded_sample(docs.select(F.col(text).cast("string").alias("text")).where(F.length("text").between(1, sample_chars)), ["text"], samples)
    e, size = encoder("library", path), width(path)
    ids, off = e.encode([r[0] for r in rows])
    parts = [serialize(np.append(ids[a:b], end_id), size) for a, b in zip(off[:-1], off[1:], strict=True)]
    try:
        return zstandard.train_dictionary(dict_bytes, parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def dict_hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw)


@lru_cache(maxsize=4)
def codecs(raw: bytes, level: int = 3):
    d = zstandard.ZstdCompressionDict(raw) if raw else None
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True), zstandard.ZstdDecompressor(dict_data=d)


def frames(docs: DataFrame, path: str, key: str, text: str, end_id: int, dictionary: bytes, bounds: list) -> DataFrame:
    """(part, key, n_ids, frame) of each document, with the range of keys it belongs to."""
    edges = np.array(bounds, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, size, z = encoder("library", path), width(path), codecs(dictionary)[0]
        for b in batches:
            for at, part in blocks(b.column(1).to_pylist(), STEP):
                ids, off = e.encode(part)
                keys = b.column(0).slice(at, len(part))
                k = np.nan_to_num(np.asarray(keys.cast(pa.float64()).fill_null(float("-inf"))), neginf=-np.inf)
                where, stop = np.searchsorted(edges, k, side="left"), np.searchsorted(edges, k, side="right")
                where += (at + np.arange(len(k))) % np.maximum(stop - where, 1)  # a key of many rows is several bounds, and as many parts
                done = [z.compress(serialize(np.append(ids[x:y], end_id), size)) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), keys, pa.array(np.diff(off) + 1, pa.int64()), pa.array(done, pa.binary())], ["part", "key", "n_ids", "frame"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), "part int, key long, n_ids long, frame binary")


def write_files(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, samples: int = 400, sample_chars: int = 4096, dict_bytes: int = 1 << 15, file_bytes: int = 8 << 20) -> bytes:
    """Write the table's token files to folder/files and the dictionary to folder/dictionary; returns the dictionary."""
    spark = docs.sparkSession
    dictionary = train(docs, path, text, end_id, samples, sample_chars, dict_bytes)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    n = partitions(spark)
    cuts = docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    size, digest = width(path), dict_hash(dictionary)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each file: a part's documents are cut where file_bytes are reached."""
        head = struct.pack(HEAD, b"BTOK", VERSION, size, digest)
        index, run, at, number, part = [], [head], len(head), 0, 0

        def whole() -> pa.RecordBatch:
            nonlocal index, run, at, number
            raw = b"".join([*run, np.array(index, INDEX).tobytes(), struct.pack(FOOT, at, len(index), part, number, b"KOTB")])
            index, run, at, number = [], [head], len(head), number + 1
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["value"])

        for b in batches:
            for p, k, n_ids, frame in zip(*(b.column(i) for i in range(4)), strict=True):
                part, raw = p.as_py(), frame.as_buffer()
                index.append((k.as_py() or 0, not k.is_valid, at, len(raw), n_ids.as_py()))
                run.append(raw)
                at += len(raw)
                if at >= file_bytes:
                    yield whole()
        if index:
            yield whole()

    # the part number is the partition, so a part is one range of keys; a row is one file
    dealt = frames(docs, path, key, text, end_id, dictionary, sorted(cuts)).repartitionById(n, F.col("part"))
    rows = dealt.sortWithinPartitions(F.col("key").asc_nulls_first(), "n_ids", "frame").mapInArrow(tidied(files), "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(f"{folder}/files")
    return dictionary


def parse(raw: memoryview, dictionary: bytes):
    """(part, number in the part, bytes per id, index array) of a file; raises where the file or its dictionary is not what it says."""
    magic, version, size, digest = struct.unpack_from(HEAD, raw, 0)
    if magic != b"BTOK" or version != VERSION or digest != dict_hash(dictionary):
        raise ValueError("not a token file of this dictionary")
    where, n, part, number, end = struct.unpack_from(FOOT, raw, len(raw) - 1 - struct.calcsize(FOOT))
    if end != b"KOTB":
        raise ValueError("the file is cut short")
    return part, number, size, np.frombuffer(raw, INDEX, n, where)


def read_document(raw: memoryview, dictionary: bytes, i: int) -> np.ndarray:
    """Ids of document i of a file: its frame alone is read."""
    _, _, size, index = parse(raw, dictionary)
    a, n = int(index["offset"][i]), int(index["size"][i])
    return np.frombuffer(codecs(dictionary)[1].decompress(raw[a : a + n]), f"<u{size}")


def read_files(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document in the files: start counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, dictionary in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = memoryview(raw.as_buffer())
                part, number, size, index = parse(raw, dictionary)
                z, crc = codecs(dictionary)[1], []
                for at, n, ids in zip(index["offset"].tolist(), index["size"].tolist(), index["ids"].tolist(), strict=True):
                    got = np.frombuffer(z.decompress(raw[at : at + n]), f"<u{size}")
                    if len(got) != ids:
                        raise ValueError("the index and a frame disagree")
                    crc.append(zlib.crc32(got.astype("<u4").tobytes()))
                n_ids = index["ids"].astype(np.int64)
                keys = pa.array(index["key"].astype(np.int64), mask=index["null"].astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), part), pa.int64()), pa.array(np.full(len(index), number), pa.int64()), keys, pa.array(np.cumsum(n_ids) - n_ids), pa.array(n_ids), pa.array(crc, pa.int64())], ["part", "number", "key", "before", "n_tokens", "ids_crc32"])

    dictionary = spark.read.parquet(f"{folder}/dictionary")  # one row of bounded size
    files = spark.read.format("binaryFile").load(f"{folder}/files").where("length > 0").select("content")
    rows = through(files.crossJoin(F.broadcast(dictionary)).mapInArrow(tidied(run), "part long, number long, key long, before long, n_tokens long, ids_crc32 long"), f"{folder}/read")
    # one row per file; the sums of a part's files need its rows alone, and parts are as many as partitions
    totals = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("ids"))
    inner = Window.partitionBy("part").orderBy("number")
    within = totals.select("part", "number", "ids", (F.sum("ids").over(inner) - F.col("ids")).alias("inside"))
    parts = totals.groupBy("part").agg(F.sum("ids").alias("all")).select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    bases = within.join(F.broadcast(parts), "part").select("part", "number", (F.col("base") + F.col("inside")).alias("base"))
    return rows.join(bases, ["part", "number"]).select(F.col("key").alias(key), (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the table's token files to the shared folder and read them back."""
    folder = shared_folder(docs.sparkSession)
    write_files(docs, folder, path, key, text, end_id)
    out = read_files(docs.sparkSession, folder, key)
    drop(docs.sparkSession, f"{folder}/files")
    return out
