"""The driver's tables as versions, edges, records, vectors and turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.schema import DAY_MS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order states its customer's order_status; P is a tombstone."""
    o, tomb = table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "P"
    at = millis("o_orderdate")
    return o.select(F.col("o_custkey").alias("entity"), F.lit("order_status").alias("attribute"), F.col("o_orderkey").alias("seq"), F.when(tomb, "absent").otherwise("value").alias("state"), F.when(~tomb, F.col("o_orderstatus")).alias("value"), at.alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), at.alias("tx"), F.lit("user_assertion").alias("source"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("session"))


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event states its user's activity, valid from some days before it was seen; error is a tombstone."""
    e, tomb, at = table(spark, sf_dir, "events"), F.col("event_type") == "error", millis("ts")
    k = F.get_json_object("props", "$.k").cast("long")
    source = F.when(F.col("event_type").isin("click", "view"), "tool_output").when(tomb, "agent_inference").otherwise("user_assertion")
    return e.select(F.col("user_id").alias("entity"), F.lit("activity").alias("attribute"), F.col("event_id").alias("seq"), F.when(tomb, "absent").otherwise("value").alias("state"), F.when(~tomb, F.col("event_type")).alias("value"), (at - k * DAY_MS).alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), at.alias("tx"), source.alias("source"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("session"))


#: Entity ids of the kinds start at these offsets.
OFFSETS = {"region": 0, "nation": 1_000, "supplier": 100_000, "customer": 10_000_000, "part": 20_000_000, "order": 1_000_000_000}


def edge_versions(spark: SparkSession, sf_dir: str, tombstones: bool = True) -> DataFrame:
    """Where nations, customers and suppliers are, who placed an order, who supplies a part (until the first return)."""

    def rows(df: DataFrame, s: str, s_kind: str, p: str, o: str, o_kind: str, at: Column, seq: int = 0, present: bool = True, later: int = 0) -> DataFrame:
        return df.select((F.col(s).cast("long") + OFFSETS[s_kind]).alias("subject"), F.lit(p).alias("predicate"), (F.col(o).cast("long") + OFFSETS[o_kind]).alias("object"), F.lit(seq).cast("long").alias("seq"), F.lit(present).alias("present"), at.cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), (at + later).cast("long").alias("tx"))

    t = lambda name: table(spark, sf_dir, name)
    zero = F.lit(0).cast("long")
    ship = t("lineitem").select("l_partkey", "l_suppkey", "l_returnflag", millis("l_shipdate").alias("at")).groupBy("l_partkey", "l_suppkey").agg(F.min("at").alias("first"), F.min(F.when(F.col("l_returnflag") == "R", F.col("at"))).alias("returned"))
    out = [
        rows(t("nation"), "n_nationkey", "nation", "in_region", "n_regionkey", "region", zero),
        rows(t("customer"), "c_custkey", "customer", "in_nation", "c_nationkey", "nation", zero),
        rows(t("supplier"), "s_suppkey", "supplier", "in_nation", "s_nationkey", "nation", zero),
        rows(t("orders"), "o_orderkey", "order", "placed_by", "o_custkey", "customer", millis("o_orderdate")),
        rows(ship, "l_partkey", "part", "supplied_by", "l_suppkey", "supplier", F.col("first")),
    ]
    if tombstones:
        out.append(rows(ship.where("returned is not null"), "l_partkey", "part", "supplied_by", "l_suppkey", "supplier", F.col("returned"), 1, False, DAY_MS))
    return reduce(DataFrame.unionAll, out)


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, record): a record for each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("record"))


def name_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, record): a record for each distinct part name, by its first part."""
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.create_map(F.lit("name"), F.col("p_name")).alias("record"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, record): each part with its name as the record."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("name"), F.col("p_name")).alias("record"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(assertion_id, entity, session, vector)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("assertion_id"), F.col("label").alias("entity"), (F.col("vec_id") % 3).alias("session"), F.col("embedding").alias("vector"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, position, speaker, text)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("position"), F.col("role").alias("speaker"), "text")


def vector_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an assertion of a topic of its label; every fourth is valid for a while only."""
    e, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    source = F.when(i % 3 == 0, "user_assertion").when(i % 3 == 1, "tool_output").otherwise("agent_inference")
    return e.select(F.col("label").cast("long").alias("entity"), F.concat(F.lit("topic"), (i % 5).cast("string")).alias("attribute"), i.alias("seq"), F.lit("value").alias("state"), F.concat(F.lit("v"), i.cast("string")).alias("value"), (i * 1000).alias("valid_from"), F.when(i % 4 == 0, i * 1000 + 100_000).alias("valid_to"), (i * 1000 + i % 7 * 5000).alias("tx"), source.alias("source"), (i % 3).cast("string").alias("session"), i.alias("assertion_id"))


def part_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, record): each part with its name, its type, and its brand, size and price band as the mark that it is blocked on."""
    mark = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"), F.lit("mark"), mark).alias("record"))
