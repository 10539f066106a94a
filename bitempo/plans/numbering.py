"""Numbers in an order, without a window over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitempo.plans.loops import cut


def number(df: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """df with the numbers first, first + 1, ... in the given order, which must be total to be repeatable.

    Rows are sorted by range over all tasks and kept; each is numbered within its
    part, and only the parts' sizes, one row for each, are added up in one place.
    """
    kept = cut(df.orderBy(*order))
    part = F.spark_partition_id()
    placed = kept.withColumn("__part", part).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    base = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n") + first).alias("__base"))
    return placed.join(F.broadcast(base), "__part").withColumn(name, (F.col("__base") + F.col("__at")).cast("long")).drop("__part", "__at", "__base")
