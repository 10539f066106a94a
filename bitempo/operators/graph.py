"""Bounded k-hop walks over the edges in force."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.operators.temporal import in_force
from bitempo.plans.loops import cut, written


@dataclass(frozen=True)
class Walk:
    """hops and budget bound the walk; via None means every predicate, an empty tuple none."""

    valid_t: int
    tx_t: int
    hops: int
    budget: int | None = None
    direction: str = "out"
    via: tuple[str, ...] | None = None


def neighbours(edges: DataFrame, walk: Walk) -> DataFrame:
    """(a, b): where one step leads, over edges in force."""
    live = in_force(edges, walk.valid_t, walk.tx_t)
    if walk.via is not None:
        live = live.where(F.col("predicate").isin(*walk.via) if walk.via else F.lit(False))
    out = live.select(F.col("subject").alias("a"), F.col("object").alias("b"))
    back = live.select(F.col("object").alias("a"), F.col("subject").alias("b"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[walk.direction].distinct()


def neighborhood(edges: DataFrame, nodes: DataFrame | None, seeds: DataFrame, walk: Walk) -> DataFrame:
    """(entity, distance, truncated): the first `budget` entities reached, nearest first, then by id.

    Seeds that are not nodes (without a table of them: ends of edges) are skipped; seeds count against the budget. A level
    depends on the whole level before it alone, so cutting the ordered result is the
    same as stopping the walk.
    """
    if nodes is None:
        edges = written(edges)  # read for its ends and for what is in force
        nodes = edges.select(F.col("subject").alias("entity")).unionAll(edges.select("object"))
    steps = written(neighbours(edges, walk)) if walk.hops > 1 else neighbours(edges, walk)
    frontier = cut(seeds.select("entity").distinct().join(nodes.select("entity"), "entity", "left_semi").withColumn("distance", F.lit(0)))
    seen = frontier
    for hop in range(1, walk.hops + 1):
        nxt = frontier.select(F.col("entity").alias("a")).join(steps, "a").select(F.col("b").alias("entity")).distinct().join(seen, "entity", "left_anti").withColumn("distance", F.lit(hop))
        frontier = cut(nxt)
        seen = seen.unionAll(frontier)
        if hop == walk.hops or not frontier.limit(1).count():
            break
        if walk.budget is not None and seen.limit(walk.budget + 1).count() > walk.budget:
            break  # later levels cannot enter the result
    if walk.budget is None:
        return seen.select("entity", "distance", F.lit(False).alias("truncated"))
    first = seen.orderBy("distance", "entity").limit(walk.budget + 1)  # at most budget + 1 rows
    return first.orderBy("distance", "entity").limit(walk.budget).crossJoin(F.broadcast(first.agg((F.count("*") > walk.budget).alias("truncated")))).select("entity", "distance", "truncated")
