"""Operator 9: quality classifier by importance resampling.

A document's features are hashed n-grams: its words, and two, three or five neighbouring shapes
(case, digits, punctuation as such, "same word again"). Two generative models count in
how many documents each feature occurs: the raw model over all documents, the target
model over documents labelled good. A document's log weight is the sum of its
features' log ratios of target to raw. A ratio counts where the two counts differ by
at least ``z`` standard deviations and it is at least as far from 0 as the one of
LEAST that parts the labelled documents best, so features that cannot tell add
nothing; of two hash functions the ratio nearer to 0 counts, so one collision does no
harm.

Documents are sampled without replacement in proportion to weight ** (1 / temperature)
by Gumbel top-k: the k largest of log weight / temperature + Gumbel noise. k is the
number of documents at or above the weight that best parts good from bad labels, a lost good document counting ``COST`` times.

Bounded, whatever the input: ``max_labels`` labelled ids are used (those with the
smallest hash), one row for each, and 2 * 2**bits counters per model. All documents
are counted and scored, whole; very long texts in steps of bounded memory, between
which no feature is counted twice. Counters are added up and turned into ratios on the
executors; the driver passes on the ratios alone, 4 bytes for each counter.

Nulls and empty texts have no features and weight 0, and stay unless good documents
weigh more than that. Rows with an id that is null or has no label are counted as raw
text alone; a repeated id has its label in every row, and the cut is judged on one of
them. The noise comes from id and text, so repeated rows tie: they stay or go together,
and only so can more than k rows stay. Without labels all stay. Extra columns are
kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitempo.llm import blocks as B
from bitempo.llm import hashing as H
from bitempo.llm.spaces import bounded_sample, free_name, shared_folder, through, tidied

BITS = 20
LEAST = (1.0, 1.5, 2.0, 2.5, 3.0)
COST = 10.0
TEMPERATURE = 1.0
#: Bytes of text turned into features at a time; a worker holds about a hundred for each.
STEP = 1 << 19
GAP, WORD, MARK = 0, 1, 2
KIND = np.full(256, WORD, np.uint8)
KIND[[c for c in range(128) if not chr(c).isalnum()]] = MARK
KIND[[32, *range(9, 14)]] = GAP
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct features of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind = KIND[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[n] = True
    new = edge.copy()
    new[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new)
    a, b = run[:-1], run[1:]
    real = kind[a] != GAP
    a, b = a[real], b[real]
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = H.prefix(LOWER[data])
    word = H.mix(H.spans(low, a, b) + (b - a).astype(np.uint64) * H.BASE2)
    upper = np.concatenate([[0], np.cumsum(UPPER[data], dtype=np.int32)])
    digit = np.concatenate([[0], np.cumsum(DIGIT[data], dtype=np.int32)])
    ups, digits = upper[b] - upper[a], digit[b] - digit[a]
    shape = np.where(digits > 0, 4, np.where((ups > 1) & (2 * ups > b - a), 3, np.where(UPPER[data[a]], 2, 1))).astype(np.uint64)
    shape = np.where(kind[a] == MARK, word | np.uint64(8), shape)
    doc = np.searchsorted(ends, a, side="right")
    again = np.zeros(len(a), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1]) & (kind[a[1:]] == WORD)
    shape[again] = 7
    pair = H.mix(shape[:-1] * H.BASE + H.mix(shape[1:] + np.uint64(11)))
    triple = H.mix(pair[:-1] + shape[2:] * H.BASE2)
    five = H.mix(triple[:-2] * H.BASE + triple[2:])
    in2, in3, in5 = doc[1:] == doc[:-1], doc[2:] == doc[:-2], doc[4:] == doc[:-4]
    who = np.concatenate([doc, doc[1:][in2], doc[2:][in3], doc[4:][in5]])
    what = np.concatenate([word, pair[in2], triple[in3], five[in5]])
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    first = np.concatenate([[True], (who[1:] != who[:-1]) | (what[1:] != what[:-1])])
    return who[first], what[first]


def steps(table: pa.Table, text: str):
    """(first row, rows, document, feature) for runs of rows of about STEP bytes."""
    data, starts, ends = B.strings(table, text)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, side="right")))
        base = int(starts[i])
        who, what = features(data[base : int(ends[j - 1])], starts[i:j] - base, ends[i:j] - base)
        yield i, j - i, who, what
        i = j


def buckets(what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    return (what & mask).astype(np.int64), ((what >> np.uint64(32)) & mask).astype(np.int64)


def log_ratios(counts: np.ndarray, n: tuple[int, int], z: float, prior: float = 1.0) -> np.ndarray:
    """Log ratio of target to raw for each bucket of counts (raw, target), 0 where the counts do not tell."""
    if not n[0] or not n[1]:
        return np.zeros(counts.shape[1:], np.float32)
    expected = counts[0] * (n[1] / n[0])
    away = (counts[1] - expected) / np.sqrt(expected + prior)
    ratio = np.log((counts[1] + prior) / (expected + prior))
    return np.where(np.abs(away) >= z, ratio, 0.0).astype(np.float32)


def feature_ratios(docs: DataFrame, labels: DataFrame, key: str, text: str, z: float) -> np.ndarray:
    """Log ratios for 2 x 2**BITS buckets, from the counts over all documents."""
    size, parts = 1 << BITS, 8

    def run(batches):
        counts, n = np.zeros((2, 2, size), np.int32), np.zeros(2, np.int64)
        for b in batches:
            t = pa.Table.from_batches([b])
            good = np.asarray(t.column("good").fill_null(False))
            n += [len(good), int(good.sum())]
            for i, _, who, what in steps(t, "text"):
                own = good[i:][who]
                for j, at in enumerate(buckets(what)):
                    np.add.at(counts[0, j], at, 1)
                    np.add.at(counts[1, j], at[own], 1)
        c = zstandard.ZstdCompressor(level=1)
        dealt = counts.reshape(2, 2, parts, size // parts)
        for p in range(parts):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([c.compress(np.ascontiguousarray(dealt[:, :, p]).tobytes())], pa.binary()), pa.array([int(n[0])]), pa.array([int(n[1])])], ["part", "counts", "n_raw", "n_target"])

    def ratios(t: pa.Table) -> pa.Table:
        d, total = zstandard.ZstdDecompressor(), np.zeros((2, 2, size // parts), np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(d.decompress(x.as_py()), np.int32).reshape(total.shape)
        n = tuple(sum(t.column(c).to_pylist()) for c in ("n_raw", "n_target"))
        return pa.table({"part": t.column("part").slice(0, 1), "ratios": pa.array([log_ratios(total, n, z).tobytes()], pa.binary())})

    told = labels.select(F.col(key).alias("id"), "good")
    marked = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(told), "id", "left").select("text", "good")
    counted = marked.mapInArrow(tidied(run), "part int, counts binary, n_raw long, n_target long")
    rows = counted.groupBy("part").applyInArrow(ratios, "part int, ratios binary").orderBy("part").collect()  # 8 rows of 1 MB
    out = np.zeros((2, parts, size // parts), np.float32)
    for r in rows:
        out[:, r["part"]] = np.frombuffer(r["ratios"], np.float32).reshape(2, -1)
    return out.reshape(2, size)


def weigh(ratios: np.ndarray, who: np.ndarray, what: np.ndarray, m: int, least: tuple[float, ...]) -> np.ndarray:
    """Log weights of m documents, a row for each least ratio."""
    a, b = (ratios[j][at] for j, at in enumerate(buckets(what)))
    near = np.where(a * b > 0, np.where(np.abs(a) < np.abs(b), a, b), 0.0)
    return np.stack([np.bincount(who, weights=np.where(np.abs(near) >= x, near, 0.0), minlength=m) for x in least])


def gumbel(hashes: np.ndarray) -> np.ndarray:
    u = (H.mix(hashes.view(np.uint64)) >> np.uint64(11)).astype(float) / 2**53
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


def weighed(docs: DataFrame, ratios: np.ndarray, key: str, text: str, noise: str) -> DataFrame:
    """(id, weights, noise) of each document: its log weights, for the ratios of LEAST, and its noise."""

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            w = np.zeros((len(LEAST), t.num_rows))
            for i, m, who, what in steps(t, "text"):
                w[:, i : i + m] = weigh(ratios, who, what, m, LEAST)
            off = np.arange(0, w.size + 1, len(LEAST), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(w.T.ravel())), pa.array(gumbel(np.asarray(b.column(2))))], ["id", "weights", "noise"])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("noise", T.DoubleType())])
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(key), F.col(text)).alias(noise)).mapInArrow(tidied(run), schema)


def reaching(docs: DataFrame, ratios: np.ndarray, key: str, text: str, i: int, temperature: float, least: float) -> DataFrame:
    """The rows whose perturbed weight, computed as in ``weighed``, is `least` or more: weighing once more takes less than writing and reading every text."""
    noise, names, at = free_name(docs, "noise"), docs.columns, docs.columns.index(text)

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([pa.RecordBatch.from_arrays([b.column(at)], ["text"])])
            w = np.zeros(t.num_rows)
            for j, m, who, what in steps(t, "text"):
                w[j : j + m] = weigh(ratios, who, what, m, (LEAST[i],))[0]
            stay = pa.array(w / temperature + gumbel(np.asarray(b.column(len(names)))) >= least)
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names).filter(stay)

    return docs.withColumn(noise, F.xxhash64(F.col(key), F.col(text))).mapInArrow(tidied(run), docs.schema)


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value, by histograms of shrinking ranges."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count("*")).first()
    above = 0
    while True:
        c = F.col(column)
        inside = df.where((c >= low) & (c <= high))
        if n <= 4096 or high <= low:
            values = sorted((r[0] for r in inside.select(column).limit(4097).collect()), reverse=True) if high > low else [low]
            return values[min(k - above, len(values)) - 1]
        step = (high - low) / 1024
        bins = dict(inside.groupBy(F.least(F.lit(1023), F.floor((c - low) / step)).alias("b")).count().collect())
        for b in sorted(bins, reverse=True):
            if above + bins[b] >= k:
                edge = inside.where(F.least(F.lit(1023), F.floor((c - low) / step)) == b).agg(F.min(column), F.max(column), F.count("*")).first()
                low, high, n = edge
                break
            above += bins[b]


def best_cut(weights, good) -> tuple[float, float]:
    """(error, cut): the weight in the middle of the widest gap among those that part good from bad with the least error."""
    w, g = np.array(weights), np.array(good)
    if not len(w) or g.all() or not g.any():
        return np.inf, -np.inf
    order = np.argsort(w, kind="stable")
    w, g = w[order], g[order]
    lost = COST * np.concatenate([[0], np.cumsum(g)]) / g.sum()  # good ones below the cut
    stay = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()  # bad ones above
    at = np.arange(len(w) + 1)
    real = (at == 0) | (at == len(w))
    real[1:-1] |= w[1:] > w[:-1]
    error = np.where(real, lost + stay, np.inf)
    best = np.flatnonzero(error <= error.min() + 1e-12)
    lows = np.where(best > 0, w[np.maximum(best - 1, 0)], w[0] - 1)
    highs = np.where(best < len(w), w[np.minimum(best, len(w) - 1)], w[-1] + 1)
    i = int(np.argmax(highs - lows))
    return float(error.min()), float((lows[i] + highs[i]) / 2)


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labels: int = 20_000, z: float = 3.0, temperature: float = TEMPERATURE, whole: bool = True) -> DataFrame:
    """The documents that the sample keeps: all their columns (whole) or (key, log_weight, sample_key)."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    good = ((F.coalesce("quality", F.lit(0)) > 0) & (F.coalesce("toxic", F.lit(1)) == 0)).alias("good")
    usable = labels.select(F.col(key), good).where(F.col(key).isNotNull()).groupBy(key).agg(F.min("good").alias("good"))
    rows = spark.createDataFrame(bounded_sample(usable, [key], max_labels), usable.schema)
    bounded = through(rows.coalesce(1), f"{folder}/labels")
    ratios = feature_ratios(docs, bounded, key, text, z)
    narrow = through(weighed(docs, ratios, key, text, "noise"), f"{folder}/weights")
    # one row for each labelled id, so at most max_labels
    known = narrow.join(F.broadcast(bounded.withColumnRenamed(key, "id")), "id").groupBy("id").agg(F.min(F.struct("weights", "good")).alias("one")).select("one.*").toArrow()
    w = np.asarray(known.column("weights").combine_chunks().flatten()).reshape(-1, len(LEAST)) if known.num_rows else np.zeros((0, len(LEAST)))
    told = np.asarray(known.column("good").to_pylist(), bool)
    _, cut, i = min(((*best_cut(w[:, i], told), i) for i in range(len(LEAST))), key=lambda c: (c[0], c[2]))
    sample = narrow.select(F.col("id").alias(key), F.col("weights")[i].alias("log_weight"), (F.col("weights")[i] / temperature + F.col("noise")).alias("sample_key"))
    k = sample.where(F.col("log_weight") >= cut).count()
    least = kth_largest(sample, "sample_key", k) if k else float("inf")
    return reaching(docs, ratios, key, text, i, temperature, least) if whole else sample.where(F.col("sample_key") >= least)
