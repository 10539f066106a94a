"""Operator 6: n-gram Jaccard join over whole texts, by prefix trees.

A document's set holds its distinct n-word shingles (with fewer words, the whole
sequence as one). Two documents link when 100 * |intersection| >= 80 * |union|.

1. Blocks of documents exchange shingle hashes, so each learns how many documents
   have each of its shingles. A shingle that one document has cannot match, and a
   document with less than 80 % of its set shared has no link at all.
2. Of documents with the same set one stands for all (a grouped minimum).
3. Sets are ordered rarest shingle first, the same everywhere. Documents that could
   link share one of their first ``shared - ceil(0.8 * size) + 1`` shingles; these
   give candidate components.
4. In a component, sets are stored in a prefix tree. A document walks the tree, the
   overlap with a path's start is counted once for all sets behind it, and a subtree
   is left when even all its remaining shingles would not suffice, or when all its
   documents are linked with the walker already.
5. A component of more than ``big`` sets is not put in one task: all its sets are
   compared with its smallest document in shares, and only sets not linked with it
   are walked against all shares.

Words are maximal runs of bytes other than blank and tab to carriage return, A-Z in
lower case. A null or empty text has size 0 and no link. A null key takes no part: its
component is null. Rows with the same key are documents of their own, and share a
component id only through links; equal texts are linked. Very long texts are one set
like others. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.llm import blocks as B
from bitempo.llm import hashing as H
from bitempo.llm.spaces import drop, partitions, shared_folder, through, tidied
from bitempo.plans.components import connected_components


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Ascending distinct shingle hashes of one text's words."""
    if not len(hashes):
        return hashes
    k = min(size, len(hashes))
    m = len(hashes) - k + 1
    out = np.full(m, np.uint64(k))
    for i in range(k):
        out = (out + hashes[i : i + m]) * H.BASE2
        out ^= out >> np.uint64(29)
    return np.unique(H.mix(out))


class Sets:
    """The shingle sets of a block's documents."""

    def __init__(self, table: pa.Table, text: str, size: int):
        data, starts, ends = B.strings(table, text)
        at, _, w = B.words(data, starts, ends)
        bounds = np.searchsorted(at, np.append(starts, len(data)))
        self.sets = [shingles(w[a:b], size) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]), return_counts=True)

    def totals(self, totals: np.ndarray) -> list[np.ndarray]:
        """For each document, how many documents have each shingle of its set."""
        distinct = self.hashes()[0]
        return [totals[np.searchsorted(distinct, s)] for s in self.sets]


def need(size: int, percent: int) -> int:
    """Least overlap of a set of this size with any set that it links with."""
    return -(-percent * size // 100)


class Tree:
    """A prefix tree (compressed paths) over ordered sets, walked with pruning."""

    class Node:
        __slots__ = ("part", "kids", "ends", "low", "high", "rest", "one")

        def __init__(self, part, low, high, rest, one):
            self.part, self.kids, self.ends = part, {}, []
            self.low, self.high, self.rest, self.one = low, high, rest, one

    def __init__(self, sizes: list[int], sets: list[np.ndarray], percent: int):
        self.sizes, self.sets, self.percent = sizes, sets, percent
        self.parent = list(range(len(sizes)))
        self.root = self.Node(np.zeros(0, np.uint64), 1 << 62, 0, 0, None)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j

    def insert(self, i: int) -> None:
        s, size, node, at = self.sets[i], self.sizes[i], self.root, 0
        own = self.find(i)
        while True:
            empty = node.low == 1 << 62
            node.low, node.high, node.rest = min(node.low, size), max(node.high, size), max(node.rest, len(s) - at - len(node.part) if node is not self.root else len(s))
            node.one = own if empty else (node.one if node.one is not None and self.find(node.one) == own else None)
            at += len(node.part)
            if at == len(s):
                node.ends.append(i)
                return
            kid = node.kids.get(int(s[at]))
            if kid is None:
                node.kids[int(s[at])] = leaf = self.Node(s[at:], size, size, 0, own)
                leaf.ends.append(i)
                return
            m = min(len(kid.part), len(s) - at)
            unlike = np.flatnonzero(kid.part[:m] != s[at : at + m])
            same = int(unlike[0]) if len(unlike) else m
            if same < len(kid.part):  # split the path
                top = self.Node(kid.part[:same], kid.low, kid.high, kid.rest + len(kid.part) - same, kid.one)
                kid.part = kid.part[same:]
                top.kids[int(kid.part[0])] = kid
                node.kids[int(s[at])] = top
                kid = top
            node = kid

    def walk(self, x: int) -> list[int]:
        """Unite x with every set in the tree that it links with; the sets that were united."""
        s, size, pct, found = np.sort(self.sets[x]), self.sizes[x], self.percent, []
        if not len(s):
            return found
        stack = [(self.root, 0, False)]
        while stack:
            node, overlap, done = stack.pop()
            if done:  # all below were seen: note where they are one component
                ones = {self.find(k.one) if k.one is not None else None for k in node.kids.values()} | {self.find(i) for i in node.ends}
                node.one = ones.pop() if len(ones) == 1 else None
                continue
            if node.one is not None and self.find(node.one) == self.find(x):
                continue
            if node.high * 100 < pct * size or node.low * pct > 100 * size:
                continue
            if len(node.part):
                at = np.searchsorted(s, node.part)
                at[at == len(s)] = 0
                overlap += int(np.count_nonzero(s[at] == node.part))
            low = max(node.low, need(size, pct))
            if (overlap + min(len(s) - overlap, node.rest)) * (100 + pct) < pct * (size + low):
                continue
            for i in node.ends:
                if i != x and overlap * (100 + pct) >= pct * (size + self.sizes[i]) and self.union(x, i):
                    found.append(i)
            if node.kids:
                stack.append((node, overlap, True))
                stack += [(k, overlap, False) for k in node.kids.values()]
        return found


def link_all(sizes: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first set of its component."""
    t = Tree(sizes, sets, percent)
    for i in range(len(sizes)):
        t.walk(i)
        t.insert(i)
    return [t.find(i) for i in range(len(sizes))]


def grouped(batches, group: list[str]):
    """Runs of rows with the same group columns from sorted batches, as lists of dicts."""
    held, now = [], None
    for b in batches:
        for row in b.to_pylist():
            g = tuple(row[c] for c in group)
            if held and g != now:
                yield now, held
                held = []
            now = g
            held.append(row)
    if held:
        yield now, held


def as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def shingle_sets(docs: DataFrame, folder: str, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(block, id, n, f1, f2, shared) of each document: size and fingerprint of its set and, where it could link, its shared shingles, rarest first."""
    blocks = B.pack(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), f"{folder}/blocks", "id", "text")
    totals = B.shared_counts(blocks, lambda t: Sets(t, "text", size).hashes(), f"{folder}/shingles")

    def run(batches):
        for b in batches:
            for block, raw, answers in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                t = B.from_ipc(raw.as_buffer())
                sets = Sets(t, "text", size)
                n, f1, f2, shared = [], [], [], []
                for s, c in zip(sets.sets, sets.totals(B.counts_of(answers or [])), strict=True):
                    n.append(len(s))
                    m = H.mix(s ^ H.BASE)
                    f1.append(int(s.sum(dtype=np.uint64)))
                    f2.append(int(m.sum(dtype=np.uint64)))
                    some = c >= 2
                    if len(s) and 100 * int(some.sum()) >= percent * len(s):
                        s, c = s[some], c[some]
                        shared.append(s[np.argsort(c, kind="stable")].tobytes())
                    else:
                        shared.append(None)
                ids = pa.concat_arrays(t.column("id").chunks)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), ids, pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.array(shared, pa.binary())], ["block", "id", "n", "f1", "f2", "shared"])

    out = through(B.with_answers(blocks, totals).mapInArrow(tidied(run), "block long, id long, n long, f1 long, f2 long, shared binary"), f"{folder}/sets")
    drop(docs.sparkSession, f"{folder}/blocks")
    drop(docs.sparkSession, f"{folder}/shingles")
    return out


def candidate_keys(reps: DataFrame, percent: int) -> DataFrame:
    """(shingle, rep): the first shingles of each set, one of which any two linked sets share."""

    def run(batches):
        for b in batches:
            for rep, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = as_set(raw)
                first = s[: len(s) - need(n, percent) + 1].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.full(len(first), rep), pa.int64())], ["shingle", "rep"])

    return reps.select("rep", "n", "shared").mapInArrow(tidied(run), "shingle long, rep long")


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, big: int = 1500, folder: str | None = None) -> DataFrame:
    """(key, n_shingles, component_id) of each document. What it works on stays in the folder, one of its own if none is given, until the result is read."""
    spark = docs.sparkSession
    folder, parts = folder or shared_folder(spark), partitions(spark)
    sets = shingle_sets(docs, folder, key, text, size, percent)
    able = sets.where("shared is not null and id is not null")
    same = ["n", "f1", "f2"]
    reps = able.groupBy(*same).agg(F.min("id").alias("rep"))
    full = through(able.join(reps.withColumnRenamed("rep", "id"), [*same, "id"]).dropDuplicates([*same, "id"]).select(F.col("id").alias("rep"), "n", "f1", "f2", "shared"), f"{folder}/reps")

    keys = through(candidate_keys(full, percent), f"{folder}/keys")
    least = keys.groupBy("shingle").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("shingle", "least")
    star = keys.join(least, "shingle").where("rep <> least").select(F.col("rep").alias("src"), F.col("least").alias("dst")).distinct()
    candidates = connected_components(star, lambda df, k: through(df, f"{folder}/candidates/{k}"))
    count = candidates.groupBy("component").agg(F.count("*").alias("members"))
    members = through(candidates.join(count, "component").join(full, F.col("node") == F.col("rep")).select("component", "members", "rep", "n", "shared"), f"{folder}/members")

    def small(batches):
        for _, rows in grouped(batches, ["component"]):
            rows.sort(key=lambda r: (r["n"], r["rep"]))
            first = link_all([r["n"] for r in rows], [as_set(r["shared"]) for r in rows], percent)
            low: dict[int, int] = {}
            for r, f in zip(rows, first, strict=True):
                low[f] = min(low.get(f, r["rep"]), r["rep"])
            yield pa.RecordBatch.from_arrays([pa.array([r["rep"] for r in rows], pa.int64()), pa.array([low[f] for f in first], pa.int64())], ["rep", "least"])

    dealt = members.where(F.col("members") <= big).repartition(parts, "component").sortWithinPartitions("component")
    linked = dealt.mapInArrow(small, "rep long, least long")
    large = members.where(F.col("members") > big)
    if large.limit(1).count():
        edges = large_links(large, folder, parts, percent, big)
        linked = linked.unionAll(connected_components(edges, lambda df, k: through(df, f"{folder}/large/{k}")).select(F.col("node").alias("rep"), F.col("component").alias("least")))
    linked = through(linked, f"{folder}/linked")

    # every set's class goes to the blocks that hold the set, and there to its documents: no key has more rows than there are blocks, or rows in a block
    classes = reps.join(linked, "rep", "left").select(*same, F.coalesce("least", "rep").alias("component"))
    told = able.select("block", *same).distinct().join(classes, same)
    joined = sets.drop("shared").join(told, ["block", *same], "left")
    able_now = F.col("id").isNotNull()
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(able_now, F.coalesce("component", "id")).alias("component_id"))


def large_links(large: DataFrame, folder: str, parts: int, percent: int, big: int) -> DataFrame:
    """Links (src, dst) that connect the components of large candidate groups: first with the group's smallest document, then of what that leaves with all."""

    def with_hub(batches):
        for b in batches:
            for r in b.to_pylist():
                s, h = as_set(r["shared"]), as_set(r["hub"])
                both = len(np.intersect1d(s, h, assume_unique=True))
                r["near"] = both * (100 + percent) >= percent * (r["n"] + r["hub_n"])
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("component", "rep", "n", "shared", "near")}], schema)

    schema = pa.schema([("component", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("shared", pa.binary()), ("near", pa.bool_())])
    hub = large.where("rep = component").select("component", F.col("n").alias("hub_n"), F.col("shared").alias("hub"))
    spread = large.withColumn("share", F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / big))).withColumn("shares", F.ceil(F.col("members") / big))
    hubs = hub.join(spread.select("component", "shares").distinct(), "component").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    seen = through(spread.join(hubs, ["component", "share"]).mapInArrow(with_hub, "component long, rep long, n long, shared binary, near boolean"), f"{folder}/near")
    sizes = seen.groupBy("component").agg(F.ceil(F.count("*") / big).alias("shares"), F.ceil(F.count_if(~F.col("near")) / big).alias("groups")).where("groups > 0")
    both = seen.join(sizes, "component")
    others = both.where("not near").withColumn("walker", F.lit(True)).withColumn("g", F.pmod(F.xxhash64("rep"), F.col("groups"))).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    shares = both.withColumn("walker", F.lit(False)).withColumn("s", F.pmod(F.xxhash64("rep"), F.col("shares"))).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    tasks = others.unionByName(shares).select("component", "g", "s", "walker", "rep", "n", "shared", "near")

    def walk(batches):
        for _, rows in grouped(batches, ["component", "g", "s"]):
            rows.sort(key=lambda r: (r["walker"], r["n"], r["rep"]))
            t = Tree([r["n"] for r in rows], [as_set(r["shared"]) for r in rows], percent)
            near = [i for i, r in enumerate(rows) if r["near"]]
            for i in near[1:]:
                t.union(near[0], i)
            own = {r["rep"]: i for i, r in enumerate(rows) if not r["walker"]}
            edges = []
            for i, r in enumerate(rows):
                if not r["walker"]:
                    t.insert(i)
                else:
                    if r["rep"] in own:
                        t.union(own[r["rep"]], i)
                    edges += [(r["rep"], rows[j]["rep"]) for j in t.walk(i)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["src", "dst"])

    found = tasks.repartition(parts, "component", "g", "s").sortWithinPartitions("component", "g", "s").mapInArrow(walk, "src long, dst long")
    return found.unionAll(seen.where("near").select(F.col("rep").alias("src"), F.col("component").alias("dst")))
