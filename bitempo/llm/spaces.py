"""Where intermediate tables go, and how they are written and read back."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; set here only where the session has none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            base = jvm_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            base = f"/tmp/bitempo-{spark.sparkContext.applicationId}"
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/bitempo-{uuid.uuid4().hex}"


def through(df: DataFrame, path: str, **options) -> DataFrame:
    """df written as Parquet at path and read back: its lineage ends there, and lost executors do not matter."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """(df written and read back with a number for each row, which stays the same each time it is read; the number's column)."""
    row = free_name(df, "row")
    return through(df.withColumn(row, F.monotonically_increasing_id()), f"{shared_folder(df.sparkSession)}/rows"), row


def drop(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settle(spark: SparkSession) -> None:
    """Have the driver notice which shuffles nothing refers to any more, so that their files are removed now and not some time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_sample(df: DataFrame, by: list[str], n: int) -> list:
    """The n rows with the smallest hash of `by`, of equal ones a single row; the same for the same table.

    Rows that cannot be among them are left out where they are read, and equal ones
    meet before the shuffle, so neither a task nor the driver gets more than some n
    rows. Where equal rows leave too few, a larger share of the hashes is read.
    """
    h, share = F.pmod(F.xxhash64(*by), F.lit(1 << 30)), min(1.0, 4 * n / max(1, df.count()))
    while True:
        rows = df.where(h < int(share * (1 << 30))).dropDuplicates(by).orderBy(h, *by).limit(n).collect()
        if len(rows) >= n or share >= 1:
            return rows
        share = min(1.0, 8 * share)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def tidy() -> None:
    """Give unused memory back to the system: a worker serves many stages, and what one keeps the next has not."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """run, tidy after each batch."""

    def tidy_run(batches):
        for out in run(batches):
            yield out
            del out
            tidy()

    return tidy_run
