"""A training-data pipeline over `documents`: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns
of documents; the last returns each kept document's token counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.llm.op01_bpe import bpe_round_trip
from bitempo.llm.op02_decontaminate import decontaminate
from bitempo.llm.op06_ngram_join import ngram_join
from bitempo.llm.op07_suffix_dedup import remove_repeats
from bitempo.llm.op09_quality import resample
from bitempo.llm.queries import byte_bpe, table
from bitempo.llm.spaces import drop, numbered, settle, shared_folder, through


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier's sample keeps, judged by all documents' features and the labels; edge cases are those of ``resample``: documents without text or label are weighed like others, repeated rows stay or go together."""
    return resample(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id, or of several such the first; rows without an id come last. Rows without words link with nothing and stay."""
    settle(spark)
    rows, row = numbered(docs)
    work = shared_folder(spark)
    linked = ngram_join(rows.select(F.col(row).alias("at"), "text"), "at", folder=f"{work}/join").select("at", "component_id")
    groups = linked.join(linked.where("component_id <> at").select("component_id").distinct(), "component_id")
    known = through(groups.join(rows.select(F.col(row).alias("at"), "doc_id"), "at"), f"{work}/groups")
    drop(spark, f"{work}/join")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at"))
    kept = known.groupBy("component_id").agg(first.alias("kept")).select(F.col("kept.at").alias("at"))
    gone = known.select("at").join(kept, "at", "left_anti")
    return rows.join(gone, rows[row] == gone["at"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that a document with a smaller id has too; n_chars is that of the text kept. A null text becomes an empty one; rows without an id lose what any other has, but nothing to each other."""
    settle(spark)
    kept = remove_repeats(docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]), f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}")
    text = f"c{docs.columns.index('text')}"
    return kept.select(*[F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item; a row's text alone decides, whatever its id."""
    settle(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document; a null text has those of an empty one."""
    return bpe_round_trip(docs, byte_bpe())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]

#: The classifier and the byte-pair encoder cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. An empty table passes through all of them; a stage's folder goes when the next one is written."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        if i:
            drop(spark, f"{folder}/stage{i - 1}")
    return docs
