"""Operator 4: exact top-k inner-product search with M-trees.

Components x become floor(1024 * x). With M the largest norm of all vectors, vector v
is placed at (v, sqrt(M^2 - |v|^2)) and query q at (q, 0); then the squared distance
is |q|^2 + M^2 - 2 <q, v>, so the nearest are those with the largest inner product,
and the triangle inequality holds. The top of the tree is made of pivots drawn from the
whole table: each vector goes to its nearest pivot's share, so a share is a ball with a
covering radius, and a share of more than ``share`` vectors (equal ones, say) is split.
Each part is a paged M-tree: an entry keeps its covering radius and its distance from
the entry above it. A best-first search opens pages by the least distance they can hold
and skips entries whose stored parent distance rules them out before computing theirs.

Queries go in blocks, twice: first to the share of their nearest pivot, which gives
each a k-th score that its answer cannot be below; then, with that bound, to the shares
whose balls can hold as much. Trees stay where they are built and written; a block of
queries, which is no larger than a tree, is what is sent.

Scores are exact integers; bounds only discard with a margin above rounding errors.
Vectors that are null or hold null or non-finite components take no part, neither as
queries nor as candidates, and neither do those whose integers' squares could add up to
2**62 or more; shorter vectors count as filled up with zeros. A null id
takes no part. Rows with a query's own id are not its candidates; other repeated rows
are candidates each. A query that repeats is one; where one id has several vectors,
each has its own ranks under that id. Equal scores are ranked by the smaller id. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitempo.llm.spaces import bounded_sample, partitions, shared_folder, through, tidied

SCALE = 1024
#: No floor for a query's scores.
LOWEST = -(1 << 63)


class MTree:
    """A paged M-tree over integer vectors, bulk-loaded."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: int, page: int = 128):
        self.ids, self.vectors, self.top, self.page = ids, vectors, top, page
        self.squares = (vectors * vectors).sum(axis=1)
        self.pages: list[tuple] = []
        # a page: (is leaf, rows of the entries, radii, distances from the entry above, child pages)
        self.root = self._load(np.arange(len(ids)), None)[0] if len(ids) else -1

    def distances(self, a: int, rows: np.ndarray) -> np.ndarray:
        """Distances of stored vectors from stored vector a."""
        lift = np.sqrt((self.top - self.squares[rows]).astype(float)) - np.sqrt(float(self.top - self.squares[a]))
        flat = self.squares[rows] + self.squares[a] - 2 * (self.vectors[rows] @ self.vectors[a])
        return np.sqrt(np.maximum(flat + lift * lift, 0))

    def _load(self, rows: np.ndarray, above: int | None) -> tuple[int, float]:
        """Page of these rows and its covering radius from the entry above."""
        up = self.distances(above, rows) if above is not None else np.zeros(len(rows))
        if len(rows) <= self.page:
            self.pages.append((True, rows, np.zeros(len(rows)), up, None))
            return len(self.pages) - 1, float(up.max(initial=0))
        fan = min(self.page, -(-2 * len(rows) // self.page))
        step = len(rows) // fan
        pivots = rows[np.argsort(up, kind="stable")][::step][:fan]
        near = np.argmin(np.stack([self.distances(int(p), rows) for p in pivots]), axis=0)
        sizes = np.bincount(near, minlength=len(pivots))
        if sizes.max() == len(rows):  # equal vectors: any split is as good
            near = np.arange(len(rows)) % len(pivots)
        entries, kids, radii = [], [], []
        for i, p in enumerate(pivots):
            own = rows[near == i]
            if len(own):
                kid, radius = self._load(own, int(p))
                entries.append(p)
                kids.append(kid)
                radii.append(radius)
        entries = np.array(entries)
        self.pages.append((False, entries, np.array(radii), self.distances(above, entries) if above is not None else np.zeros(len(entries)), np.array(kids)))
        return len(self.pages) - 1, float(up.max(initial=0))

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) other than id own, and the number of distances computed; with a floor, scores below it need not be found."""
        base = int((q * q).sum()) + self.top
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        computed, tick = 0, 0
        queue: list[tuple] = [(0.0, 0, self.root, None)] if self.root >= 0 else []
        margin = 1e-6 * (1 + np.sqrt(float(base)))
        limit = np.inf if floor is None else np.sqrt(max(0.0, float(base - 2 * floor))) + margin
        while queue:
            least, _, number, above = heapq.heappop(queue)
            if least > limit:
                break
            leaf, rows, radii, up, kids = self.pages[number]
            if above is not None and limit < np.inf:
                keep = np.flatnonzero(np.abs(above - up) - radii <= limit)
                rows, radii, up = rows[keep], radii[keep], up[keep]
                kids = kids[keep] if kids is not None else None
            if not len(rows):
                continue
            scores = self.vectors[rows] @ q
            computed += len(rows)
            if leaf:
                some = np.arange(len(rows))
                if len(best) == k:
                    some = np.flatnonzero(scores >= best[0][0])
                for s, i in zip(scores[some].tolist(), self.ids[rows[some]].tolist(), strict=True):
                    if i == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    limit = min(limit, np.sqrt(max(0.0, float(base - 2 * best[0][0]))) + margin)
            else:
                d = np.sqrt(np.maximum(base - 2 * scores, 0).astype(float))
                low = np.maximum(d - radii, 0)
                for a, b, c in zip(low.tolist(), kids.tolist(), d.tolist(), strict=True):
                    if a <= limit:
                        tick += 1
                        heapq.heappush(queue, (a, tick, b, c))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1])), computed


def integer_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<bigint>) of the rows that take part."""
    x = F.col(vector)
    most = float(1 << 31) / SCALE  # the greatest component; their squares' sum is checked as a double
    whole = x.isNotNull() & F.col(key).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) >= most))
    rows = df.where(whole).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long")).alias("v"))
    return rows.where(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")) < float(1 << 62))


def matrix(column: pa.ListArray) -> np.ndarray:
    """A list column as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    size = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.asarray(column.flatten())
    return out


def least(v: np.ndarray) -> np.ndarray:
    """v in the narrowest integers that hold it."""
    for t in (np.int16, np.int32):
        if not v.size or np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max:
            return v.astype(t)
    return v


def fit(v: np.ndarray, wide: int) -> np.ndarray:
    return np.pad(v, ((0, 0), (0, max(0, wide - v.shape[1]))))[:, :wide].astype(np.int64)


def lifted(v: np.ndarray, top: int) -> np.ndarray:
    """The last coordinate of stored vectors."""
    return np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0).astype(float))


def top_k(df: DataFrame, queries: DataFrame | None = None, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", share: int = 16384, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of df's rows. Queries: those given, else the rows whose id is divisible by every."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    rows = through(integer_vectors(df, key, vector), f"{folder}/vectors")
    asked = integer_vectors(queries, key, vector) if queries is not None else rows.where(F.pmod("id", F.lit(every)) == 0)
    # zeros at a vector's end say nothing; a query's number tells apart the vectors of one id
    filled = F.coalesce(F.array_max(F.transform("v", lambda c, i: F.when(c != 0, i + 1).otherwise(0))), F.lit(0))
    asked = asked.select("id", F.slice("v", F.lit(1), filled).alias("v")).distinct()
    asked = asked.withColumn("q", F.row_number().over(Window.partitionBy("id").orderBy("v")).cast("long"))
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    n, top, wide = rows.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    top, wide = int(top or 0), int(wide or 0)
    # one pivot for each share: some 100 bytes for every `share` rows reach the driver
    drawn = bounded_sample(rows.select("v"), ["v"], max(1, -(-n // share)))
    pivots = fit(matrix(pa.array([r["v"] for r in drawn], pa.list_(pa.int64()))), wide)
    heights = lifted(pivots, top)

    def nearest(v: np.ndarray, height: np.ndarray | float) -> np.ndarray:
        """Squared distances from the pivots, as doubles that are exact below 2**53."""
        flat = ((pivots * pivots).sum(axis=1)[None, :] + (v * v).sum(axis=1)[:, None] - 2 * (v @ pivots.T)).astype(float)
        return np.maximum(flat + (heights[None, :] - (height[:, None] if isinstance(height, np.ndarray) else height)) ** 2, 0)

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = fit(matrix(b.column(1)), wide)
            d = nearest(v, lifted(v, top))
            home = np.argmin(d, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home), pa.array(np.sqrt(d[np.arange(len(home)), home]))], ["id", "v", "home", "far"])

    dealt = through(rows.mapInArrow(tidied(deal), "id long, v array<bigint>, home long, far double"), f"{folder}/dealt")
    balls = dealt.groupBy("home").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / share).alias("parts")).orderBy("home").collect()  # a row for each pivot
    radius = np.array([r["radius"] for r in balls])
    homes = np.array([r["home"] for r in balls], np.int64)
    sizes = F.broadcast(spark.createDataFrame([(r["home"], r["parts"]) for r in balls], "home long, parts long"))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending")])
        tree = MTree(np.asarray(t.column("id")), matrix(t.column("v")), top)
        tree.vectors = least(tree.vectors)
        return pa.table({"home": t.column("home").slice(0, 1), "part": t.column("part").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    placed = dealt.join(sizes, "home").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("home", "part", "id", "v")
    trees = through(placed.groupBy("home", "part").applyInArrow(build, "home long, part long, tree binary"), f"{folder}/trees")

    def visits(batches, far: bool):
        """(home, id, q, v, floor): the shares that each query goes to."""
        for b in batches:
            if not b.num_rows:
                continue
            v = fit(matrix(b.column("v")), wide)
            d = np.sqrt(nearest(v, 0.0))[:, homes]
            near = np.argmin(np.maximum(d - radius, 0), axis=1)
            if far:
                floor = np.asarray(b.column("floor").fill_null(LOWEST))
                reach = np.where(floor == LOWEST, np.inf, np.sqrt(np.maximum((v * v).sum(axis=1) + top - 2.0 * floor, 0))) + 1e-6 * (1 + np.sqrt((v * v).sum(axis=1) + float(top)))
                go = np.maximum(d - radius, 0) <= reach[:, None]
                go[np.arange(len(v)), near] = False
            else:
                go = np.zeros(d.shape, bool)
                go[np.arange(len(v)), near] = True
            who, where = np.nonzero(go)
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays([pa.array(homes[where]), b.column("id").take(at), b.column("q").take(at), b.column("v").take(at), b.column("floor").take(at)], ["home", "id", "q", "v", "floor"])

    def pack(t: pa.Table) -> pa.Table:
        v = least(matrix(t.column("v")))
        floor = np.asarray(pc.fill_null(t.column("floor"), LOWEST))
        return pa.table({"home": t.column("home").slice(0, 1), "g": t.column("g").slice(0, 1), "asked": pa.array([pickle.dumps((np.asarray(t.column("id")), np.asarray(t.column("q")), v, floor))], pa.binary())})

    def run(batches):
        for b in batches:
            for tree, asked in zip(b.column(0), b.column(1), strict=True):
                tree, (ids, numbers, vectors, floors) = pickle.loads(tree.as_buffer()), pickle.loads(asked.as_buffer())
                tree.vectors = tree.vectors.astype(np.int64)
                vectors = fit(vectors, tree.vectors.shape[1])
                out = [(i, n, v, s) for i, n, q, f in zip(ids.tolist(), numbers.tolist(), vectors, floors.tolist(), strict=True) for s, v in tree.search(q, i, k, None if f == LOWEST else f)[0]]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(4)], ["query_id", "q", "vec_id", "score"])

    def searched(queries: DataFrame, far: bool, name: str) -> DataFrame:
        go = queries.select("id", "q", "v", "floor").mapInArrow(tidied(lambda batches: visits(batches, far)), "home long, id long, q long, v array<bigint>, floor long")
        go = through(go, f"{folder}/{name}_visits")
        groups = go.groupBy("home").agg(F.ceil(F.count("*") / block).alias("groups"))
        packed = go.join(F.broadcast(groups), "home").withColumn("g", F.pmod(F.xxhash64("id", "q"), F.col("groups"))).groupBy("home", "g").applyInArrow(pack, "home long, g long, asked binary")
        tasks = trees.join(packed, "home").repartition(partitions(spark), "home", "part", "g").select("tree", "asked")
        return through(tasks.mapInArrow(tidied(run), "query_id long, q long, vec_id long, score long"), f"{folder}/{name}")

    by = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    first = asked.withColumn("floor", F.lit(None).cast("long"))
    near = searched(first, False, "near") if len(homes) else spark.createDataFrame([], "query_id long, q long, vec_id long, score long")
    if len(homes) > 1:
        floors = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "q", F.col("score").alias("floor"))
        near = near.unionByName(searched(asked.join(floors, ["id", "q"], "left"), True, "far"))
    found = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
