"""Operator 1: BPE encoding and decoding of whole texts.

Each distinct piece is encoded by the priority-queue encoder of ``bpe`` and kept in
a bounded cache of the Python worker; texts are split and put together in NumPy.

Nulls and empty texts give no ids and an empty decoded text. Repeated rows give
repeated results. Extra columns are ignored. No shuffle, no state beyond the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.llm.backends import encoder
from bitempo.llm.spaces import tidied

#: Characters of text encoded at a time.
BLOCK = 1 << 20


def blocks(texts: list[str | None], limit: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about limit characters, with the first one's position."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > limit:
            yield at, [t or "" for t in texts[at:i]]
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, [t or "" for t in texts[at:]]


def encode_texts(texts: list[str | None], path: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Ids of each text, block by block."""
    e = encoder("heap", path)
    for at, part in blocks(texts):
        ids, off = e.encode(part)
        yield at, [ids[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def bpe_encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each row: its text's token ids."""

    def run(batches):
        for b in batches:
            for at, ids in encode_texts(b.column(1).to_pylist(), path):
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32()))], [key, "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text).cast("string")).mapInArrow(tidied(run), f"`{key}` {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text string) of each row: its ids' vocabulary strings put together, as UTF-8 with replacement of what is not."""

    def run(batches):
        v = encoder("heap", path).backend.vocabulary
        for b in batches:
            rows = [v.decode(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.string())], [key, "text"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, ids).mapInArrow(tidied(run), f"`{key}` {kind}, text string")


def bpe_round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row: digests of its ids and of the text decoded from them."""

    def run(batches):
        v = encoder("heap", path).backend.vocabulary
        for b in batches:
            for at, ids in encode_texts(b.column(1).to_pylist(), path):
                n = [len(x) for x in ids]
                written = [hashlib.sha256(v.decimals(x)).hexdigest() if len(x) else hashlib.sha256(b"").hexdigest() for x in ids]
                decoded = []
                for x in ids:
                    raw = v.decode(x)
                    if not raw.isascii():
                        raw = raw.decode("utf-8", "replace").encode()
                    decoded.append(hashlib.sha256(raw).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), pa.array(n, pa.int64()), pa.array(written), pa.array(decoded)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text).cast("string")).mapInArrow(tidied(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
