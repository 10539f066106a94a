"""Exact filtered vector search: scope first, then scores, then the k best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
#: Rows scored at a time.
STEP = 1024


def problems(vector: str, dim: int, metric: str = "cosine") -> Column:
    """Why a vector cannot be stored, or null."""
    v = F.col(vector)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    bad, at = F.exists(v, odd), F.array_position(F.transform(v, lambda x: F.coalesce(odd(x), F.lit(True))), True) - 1
    zero = ~F.exists(v, lambda x: x != 0)
    return F.when(v.isNull() | (F.size(v) != dim), "wrong dimension").when(bad, F.concat(F.lit("not finite at "), at.cast("string"))).when(zero & F.lit(metric == "cosine"), "zero vector")


def norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def prepare(df: DataFrame, dim: int, metric: str = "cosine", vector: str = "vector") -> DataFrame:
    """The rows whose vector can be stored; under cosine of unit length, by a double norm."""
    ok = df.where(problems(vector, dim, metric).isNull())
    if metric != "cosine":
        return ok.withColumn(vector, F.transform(vector, lambda x: x.cast("double")))
    return ok.withColumn("__norm", norm(vector)).withColumn(vector, F.transform(vector, lambda x: x.cast("double") / F.col("__norm"))).drop("__norm")


def upsert(index: DataFrame, new: DataFrame, key: str = "assertion_id") -> DataFrame:
    return index.join(new.select(key), key, "left_anti").unionByName(new)


def remove(index: DataFrame, gone: DataFrame, key: str = "assertion_id") -> DataFrame:
    return index.join(gone.select(key).distinct(), key, "left_anti")


class Index:
    """Stored vectors of one dimension and metric."""

    def __init__(self, rows: DataFrame, dim: int, metric: str = "cosine"):
        if dim < 1 or metric not in ("cosine", "l2"):
            raise ValueError("an index needs a dimension and a metric")
        self.rows, self.dim, self.metric = rows, dim, metric

    def __len__(self) -> int:
        return self.rows.count()

    def __contains__(self, assertion_id: int) -> bool:
        return bool(self.rows.where(F.col("assertion_id") == assertion_id).limit(1).count())

    def insert(self, new: DataFrame) -> Index:
        bad = new.withColumn("why", problems("vector", self.dim, self.metric)).where("why is not null").select("why").first()
        if bad:
            raise ValueError(bad["why"])
        return Index(upsert(self.rows, prepare(new, self.dim, self.metric)), self.dim, self.metric)

    def remove(self, gone: DataFrame) -> Index:
        return Index(remove(self.rows, gone), self.dim, self.metric)

    def search(self, queries: DataFrame, k: int, keep: Column | None = None, match: list[str] | None = None) -> DataFrame:
        return search(self.rows, prepare(queries, self.dim, self.metric), k, self.metric, match, keep)

    @staticmethod
    def open(rows: DataFrame, dim: int, metric: str = "cosine") -> Index:
        """An index of rows that all can be in it; refused with a reason otherwise."""
        out = Index(rows, dim, metric)
        bad = rows.withColumn("why", problems("vector", dim, "l2")).where("why is not null").select("why").first()
        if bad:
            raise ValueError(bad["why"])
        if rows.groupBy("assertion_id").count().where("count > 1").limit(1).count():
            raise ValueError("a vector id is used twice")
        return out


#: Bytes of query vectors that every task gets; more queries go in blocks that rows meet.
ASKED_BYTES = 16 << 20


def search(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", match: list[str] | None = None, keep: Column | None = None) -> DataFrame:
    """(query_id, rank, assertion_id, score) of each query (query_id, vector), by (score descending, id ascending).

    keep is the scope that hits must be in, match names columns in which a hit must
    equal its query. Queries of at most ASKED_BYTES go to the rows, which stay where they
    are read unless there are many queries: each task gives its k best for each query. More queries are packed into
    blocks of a fixed size; a row meets a block, not a query, and each batch of rows
    gives a block's k best only, so what is shuffled is small.
    """
    match = match or []
    index = index if keep is None else index.where(keep)
    if k <= 0:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, assertion_id long, score double")
    dim = queries.select(F.size("vector")).limit(1).collect()
    most = max(1, ASKED_BYTES // (8 * max(1, dim[0][0] if dim else 1)))
    told = queries.select(F.col("query_id").cast("long").alias("query_id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"), *match)
    few = told.limit(most + 1).toArrow()
    if few.num_rows <= most:
        return _near_rows(index, few, k, metric, match)
    groups = max(1, -(-queries.count() // BLOCK))
    packed = queries.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups))).groupBy("g").agg(F.collect_list(F.struct(F.col("query_id").cast("long").alias("query_id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"), *match)).alias("asked"))
    rows = index.select(F.col("assertion_id").cast("long").alias("assertion_id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"), *match)
    # rows go in packs too, so a pack and a block are one matrix product
    packs = rows.withColumn("p", F.pmod(F.xxhash64("assertion_id"), F.lit(max(1, -(-index.count() // 4096))))).groupBy("p").agg(F.collect_list(F.struct("assertion_id", "vector", *match)).alias("rows"))
    tasks = packs.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).join(packed, "g")

    def run(batches):
        for b in batches:
            for held, asked in zip(b.column(0), b.column(1), strict=True):
                held, asked = held.values, asked.values
                x, q = (np.asarray(t.field("vector").flatten()).reshape(len(t), -1) for t in (held, asked))
                best = Nearest(np.asarray(asked.field("query_id")), q, k, metric)
                best.add(np.asarray(held.field("assertion_id")), x, [(np.asarray(asked.field(m)), np.asarray(held.field(m))) for m in match])
                yield from best.rows()

    found = tasks.select("rows", "asked").mapInArrow(run, "query_id long, assertion_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "assertion_id"))
    return found.select("query_id", rank.alias("rank"), "assertion_id", "score").where(F.col("rank") <= k)


#: Scores held at a time: a tile of queries and rows.
TILE = 1 << 20
#: How far a score by a matrix product may be from the score of its pair alone, of the squares it is made of.
SLACK = 1e-11


def exact_scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """The score of each q[i] and x[i], in the same steps wherever they stand, so equal pairs have equal scores."""
    if metric == "cosine":
        return (q * x).sum(axis=1)
    return -np.sqrt(((q - x) ** 2).sum(axis=1))


class Nearest:
    """The k best (score descending, id ascending) of each query among the rows added.

    A tile of scores comes from one matrix product; pairs that may be among the k best
    by it, give or take its rounding, are scored again each on its own. What is held
    is a tile, the k best of each query, and the pairs of a tile that may be among
    them, which are taken in parts.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str):
        self.ids, self.q, self.k, self.metric = ids, np.ascontiguousarray(q, np.float64), k, metric
        self.square = (self.q**2).sum(axis=1)
        # places not yet taken have the score -inf
        self.found, self.score = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)

    def add(self, names: np.ndarray, x: np.ndarray, match: list[tuple[np.ndarray, np.ndarray]] = ()) -> None:
        x = np.ascontiguousarray(x, np.float64)
        for low in range(0, len(x), STEP):
            part = slice(low, low + STEP)
            rows, square = x[part], (x[part] ** 2).sum(axis=1)
            many = max(1, TILE // max(1, len(rows)))
            for at in range(0, len(self.ids), many):
                asked = slice(at, at + many)
                # in squares: of a cosine the score itself, of a distance minus its square
                near = self.q[asked] @ rows.T
                size = self.square[asked][:, None] + square[None, :]
                if self.metric != "cosine":
                    near = 2 * near - size
                for own, theirs in match:
                    near[own[asked][:, None] != theirs[part][None, :]] = -np.inf
                floor = self.score[asked, -1]
                floor = floor if self.metric == "cosine" else -(floor**2)
                if near.shape[1] > self.k:
                    # the k-th best of the tile itself, where that is more
                    floor = np.maximum(floor, np.partition(near, -self.k, axis=1)[:, -self.k])
                # what no row matches is -inf and never taken
                i, j = np.nonzero((near >= floor[:, None] - SLACK * size) & (near > -np.inf))
                self._take(i + at, names[part], rows, j)

    def _take(self, i: np.ndarray, names: np.ndarray, rows: np.ndarray, j: np.ndarray) -> None:
        for low in range(0, len(i), TILE // 16):
            high = low + TILE // 16
            a, b = i[low:high], j[low:high]
            s = exact_scores(self.q[a], rows[b], self.metric)
            own = np.unique(a)
            held = self.score[own] > -np.inf
            a = np.concatenate([a, np.repeat(own, held.sum(axis=1))])
            n, s = np.concatenate([names[b], self.found[own][held]]), np.concatenate([s, self.score[own][held]])
            order = np.lexsort((n, -s, a))
            a, n, s = a[order], n[order], s[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            top = place < self.k
            self.score[own] = -np.inf
            self.found[a[top], place[top]], self.score[a[top], place[top]] = n[top], s[top]

    def rows(self):
        for low in range(0, len(self.ids), 4096):
            held = self.score[low : low + 4096] > -np.inf
            if held.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids[low : low + 4096], held.sum(axis=1)), pa.int64()), pa.array(self.found[low : low + 4096][held]), pa.array(self.score[low : low + 4096][held])], ["query_id", "assertion_id", "score"])


def _near_rows(index: DataFrame, asked: pa.Table, k: int, metric: str, match: list[str]) -> DataFrame:
    """search for queries that fit in every task."""
    ids = np.asarray(asked.column("query_id"))
    q = np.asarray(asked.column("vector").combine_chunks().flatten()).reshape(len(ids), -1 if len(ids) else 1)
    own = [np.asarray(asked.column(m)) for m in match]

    def run(batches):
        best = Nearest(ids, q, k, metric)
        for b in (b for b in batches if b.num_rows):
            x = np.asarray(b.column(1).flatten().cast(pa.float64())).reshape(b.num_rows, -1)
            best.add(np.asarray(b.column(0)), x, [(m, np.asarray(b.column(2 + j))) for j, m in enumerate(own)])
        yield from best.rows()

    rows = index.select(F.col("assertion_id").cast("long").alias("assertion_id"), "vector", *match)
    if len(ids) > BLOCK:
        # much work for a row: all tasks take part, however few files there are
        rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    found = rows.mapInArrow(run, "query_id long, assertion_id long, score double") if len(ids) else rows.select(F.lit(0).cast("long").alias("query_id"), "assertion_id", F.lit(0.0).alias("score")).where("false")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "assertion_id"))
    return found.select("query_id", rank.alias("rank"), "assertion_id", "score").where(F.col("rank") <= k)
