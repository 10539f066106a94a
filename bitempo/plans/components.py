"""Connected components as a driver loop of bounded DataFrame jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, save: Callable[[DataFrame, int], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for the nodes of an undirected edge list; a component is named by its smallest node.

    Alternates large-star and small-star steps until no edge changes; each step is a
    grouped minimum, combined before its shuffle, so a node with very many neighbours
    does not fill a task. save(df, step) must store df and return it with its lineage
    cut (a checkpoint or a written table). Loops and repeated edges do no harm.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, step, before = save(e, 0), 0, None
    while True:
        # large star: each node's larger neighbours are joined to its smallest neighbour or itself
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node's smaller neighbours and itself are joined to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        e = save(small, step)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionAll(members.select(F.col("component").alias("node"), "component").distinct())
