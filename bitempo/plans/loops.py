"""Cutting the lineage of driver loops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Make sure the session has a checkpoint folder; one of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or f"/tmp/bitempo-{sc.applicationId}")


def cut(df: DataFrame, step: int = 0) -> DataFrame:
    """df, computed once and kept in the checkpoint folder, which lost executors do not touch."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder: computed once, and what reads it later reads the columns it needs."""
    ready(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows, by the planner's estimate, that one task is to take.
SHARE_BYTES = 64 << 20


def shares(df: DataFrame) -> int:
    """Over how many tasks rows like df's are dealt, so that a task's share does not grow with the table: as many as shuffles have, or more where the planner expects more than SHARE_BYTES for each."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(8192, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE_BYTES) if size < 1 << 50 else 0))
