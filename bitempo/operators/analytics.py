"""Analytics over a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.schema import LOG


def attribute_sprawl(versions: DataFrame) -> DataFrame:
    """(attributes, used_once, share_once, per_name) without the attribute kind."""
    per = versions.where("attribute <> 'kind'").groupBy("attribute").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("attributes"), F.count_if(F.col("n") == 1).alias("used_once"), (F.count_if(F.col("n") == 1) / F.count("*")).alias("share_once"), F.avg("n").alias("per_name"))


def contested(versions: DataFrame) -> DataFrame:
    """(attribute, logs, contested, inside): logs with more than one version, and the assertions in them."""
    logs = versions.groupBy(*LOG).agg(F.count("*").alias("n"))
    return logs.groupBy("attribute").agg(F.count("*").alias("logs"), F.count_if(F.col("n") > 1).alias("contested"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("inside"))


def stem_families(names: DataFrame, column: str = "attribute", least: int = 3) -> DataFrame:
    """(stem, members): names that share the first six letters of their leading run of letters (four at least)."""
    stem = F.substring(F.regexp_extract(F.lower(column), "^([a-z]+)", 1), 1, 6)
    out = names.select(column).distinct().withColumn("stem", stem).where(F.length("stem") >= 4)
    return out.groupBy("stem").agg(F.count("*").alias("members")).where(F.col("members") >= least)


def response_shape(items: DataFrame) -> DataFrame:
    """(responses, none, two_or_more, relations, unanchored) over the salvage rows of extraction."""
    one = items.groupBy("session", "position").agg(F.count_if((F.col("section") == "mentions") & F.col("why").isNull()).alias("m"), F.count_if((F.col("section") == "relations") & F.col("why").isNull()).alias("r"), F.count_if(F.col("why").contains("names no mention")).alias("u"))
    return one.agg(F.count("*").alias("responses"), F.count_if(F.col("m") == 0).alias("none"), F.count_if(F.col("m") >= 2).alias("two_or_more"), F.sum("r").alias("relations"), F.sum("u").alias("unanchored"))


def recall_at_k(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """(category, questions, hit, recall): a question counts where any of its hits is evidence; hits (query_id, assertion_id), truth (query_id, category, evidence)."""
    good = hits.join(truth.select("query_id", F.col("evidence").alias("assertion_id")), ["query_id", "assertion_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    asked = truth.select("query_id", "category").distinct().join(good, "query_id", "left")
    return asked.groupBy("category").agg(F.count("*").alias("questions"), F.count("hit").alias("hit"), (F.count("hit") / F.count("*")).alias("recall"))


def kind_mismatch(review: DataFrame, kinds: DataFrame) -> DataFrame:
    """(pairs, different): review pairs (a, b), and those whose kinds (id, kind) differ."""
    both = review.join(kinds.select(F.col("id").alias("a"), F.col("kind").alias("ka")), "a").join(kinds.select(F.col("id").alias("b"), F.col("kind").alias("kb")), "b")
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("ka") != F.col("kb")).alias("different"))


def overlap(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact hits that were found."""
    f = found.groupBy("query_id").agg(F.collect_set("assertion_id").alias("f"))
    e = exact.groupBy("query_id").agg(F.collect_set("assertion_id").alias("e"))
    return e.join(f, "query_id", "left").select("query_id", (F.size(F.array_intersect("e", F.coalesce("f", F.array().cast("array<bigint>")))) / F.size("e")).alias("recall"))


def parse_when(c):
    """Epoch milliseconds of texts such as '1:56 pm on 8 May, 2023'; null for others."""
    return F.unix_millis(F.try_to_timestamp(F.upper(c), F.lit("h:mm a 'ON' d MMMM, yyyy")))
