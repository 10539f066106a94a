"""Writes as table-to-table functions: logs are appended to, erased or re-pointed, never edited in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitempo.operators.temporal import in_force
from bitempo.plans.components import connected_components
from bitempo.plans.loops import cut, shares
from bitempo.plans.numbering import number
from bitempo.schema import LOG, TRIPLE


class UnknownEntity(ValueError):
    """A write names an entity that does not exist."""


def create_entities(entities: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New entities with the next ids, in the given order."""
    top = entities.agg(F.max("entity")).first()[0]
    return number(new, [order], "entity", 0 if top is None else top + 1)


def require_entities(rows: DataFrame, entities: DataFrame, column: str = "entity") -> DataFrame:
    missing = rows.join(entities.select(F.col("entity").alias(column)), column, "left_anti").select(column).limit(1).collect()
    if missing:
        raise UnknownEntity(f"no entity {missing[0][0]}")
    return rows


def assert_versions(versions: DataFrame, rows: DataFrame, entities: DataFrame) -> DataFrame:
    """The log with rows behind it; a row of an unknown entity is an error, and then nothing is written."""
    return append(versions, require_entities(rows, entities), LOG)


def append(log: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """rows behind their logs, in the order of (tx, seq), with the seqs that follow."""
    last = log.groupBy(*by).agg(F.max("seq").alias("last"))
    n = F.row_number().over(Window.partitionBy(*by).orderBy("tx", "seq"))
    numbered = filled(rows, log).withColumn("n", n).join(last, by, "left").withColumn("seq", F.coalesce(F.col("last"), F.lit(-1)) + F.col("n"))
    return log.unionByName(numbered.select(*log.columns))


def filled(rows: DataFrame, like: DataFrame) -> DataFrame:
    """rows with a null in every column of like that they lack."""
    lacking = [f for f in like.schema.fields if f.name not in rows.columns]
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lacking])


def erase_attribute(versions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the logs that stay, (entity, attribute, erased) of those destroyed); gone: (entity, attribute)."""
    lost = versions.join(gone.select(*LOG).distinct(), LOG, "left_semi").groupBy(*LOG).agg(F.count("*").alias("erased"))
    return versions.join(gone.select(*LOG).distinct(), LOG, "left_anti"), lost


def forget_attribute(versions: DataFrame, vectors: DataFrame, gone: DataFrame, at: int, source: str, session: str) -> tuple[DataFrame, DataFrame]:
    """(versions with a tombstone from `at` behind each log that is forgotten, vectors without theirs). History still answers; a tombstone has no vector."""
    asked = gone.select(*LOG).distinct()
    tomb = asked.select(*LOG, F.lit(0).cast("long").alias("seq"), F.lit("absent").alias("state"), F.lit(None).cast("string").alias("value"), F.lit(at).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.lit(at).cast("long").alias("tx"), F.lit(source).alias("source"), F.lit(session).alias("session"))
    return append(versions, tomb, LOG), vectors.join(asked, LOG, "left_anti")


def relate(edges: DataFrame, new: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """new (subject, predicate, object, valid_from, valid_to, tx) behind their logs. Both ends must exist; no edge leads to itself."""
    if new.where("subject = object").limit(1).count():
        raise ValueError("an edge cannot lead to itself")
    if entities is not None:
        require_entities(new, entities, "subject")
        require_entities(new, entities, "object")
    return append(edges, new.withColumn("present", F.lit(True)).withColumn("seq", F.lit(0).cast("long")), TRIPLE)


def unrelate(edges: DataFrame, gone: DataFrame, at: int) -> DataFrame:
    """A tombstone from `at` behind each of the triples' logs; no earlier edge is needed."""
    tomb = gone.select(*TRIPLE).distinct().select(*TRIPLE, F.lit(0).cast("long").alias("seq"), F.lit(False).alias("present"), F.lit(at).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.lit(at).cast("long").alias("tx"))
    return append(edges, tomb, TRIPLE)


def erase_edges(edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the edges that stay, (entity, erased) in triples, not versions), for entities in either role."""
    ids = gone.select("entity").distinct()
    stay = edges.join(ids.withColumnRenamed("entity", "subject"), "subject", "left_anti").join(ids.withColumnRenamed("entity", "object"), "object", "left_anti").select(*edges.columns)
    triples = edges.select(*TRIPLE).distinct()
    ends = triples.select(F.col("subject").alias("entity"), *TRIPLE).unionAll(triples.select(F.col("object").alias("entity"), *TRIPLE)).distinct()
    return stay, ends.join(ids, "entity", "left_semi").groupBy("entity").agg(F.count("*").alias("erased"))


def repoint_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges with absorbed ends replaced by kept ones; merged: (absorbed, kept), chains followed to their end.

    What would lead to itself is dropped. Logs that come together are put in the order
    of tx, the kept entity's own first at equal tx; other logs keep their order. Tasks
    take shares of a fixed size, which are not put together again by their packed size.
    """
    merged, n = roots(merged), shares(edges)
    side = lambda c: merged.select(F.col("absorbed").alias(c), F.col("kept").alias(f"k_{c}")).repartition(n, c)
    moved = edges.repartition(n, "subject").join(side("subject"), "subject", "left").repartition(n, "object").join(side("object"), "object", "left")
    moved = moved.withColumn("origin", F.when(F.col("k_subject").isNull() & F.col("k_object").isNull(), 0).otherwise(1)).withColumn("old", F.struct("subject", "object"))
    moved = moved.withColumn("subject", F.coalesce("k_subject", "subject")).withColumn("object", F.coalesce("k_object", "object")).where("subject <> object").repartition(n, *TRIPLE)
    w = Window.partitionBy(*TRIPLE)
    many = F.size(F.collect_set("old").over(w)) > 1
    order = F.row_number().over(w.orderBy("tx", "origin", "old", "seq")) - 1
    return moved.withColumn("seq", F.when(many, order.cast("long")).otherwise(F.col("seq"))).select(*edges.columns)


def repointed(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """(kept, moved): how many triples each survivor took over, those that would lead to itself among them."""
    merged, n = roots(merged), shares(edges)
    # edges are read once, and told apart only where an end is absorbed
    ends = edges.select(F.explode(F.array("subject", "object")).alias("absorbed"), *TRIPLE)
    moved = ends.repartition(n, "absorbed").join(merged.repartition(n, "absorbed"), "absorbed").select("kept", *TRIPLE)
    return moved.repartition(n, "kept").distinct().groupBy("kept").agg(F.count("*").alias("moved"))


def roots(merged: DataFrame) -> DataFrame:
    """(absorbed, kept) with chains followed: of all that merge into each other the smallest is kept."""
    found = connected_components(merged.select(F.col("absorbed").alias("src"), F.col("kept").alias("dst")), cut)
    return found.where("node <> component").select(F.col("node").alias("absorbed"), F.col("component").alias("kept"))


def fold_identity(identity: DataFrame, merged: DataFrame) -> DataFrame:
    """(entity, record) after merges given as roots: each field as the smallest entity of the group that has it spells it."""
    told = identity.join(merged.select(F.col("absorbed").alias("entity"), "kept"), "entity", "left").withColumn("to", F.coalesce("kept", "entity"))
    fields = told.select("to", "entity", F.explode_outer("record").alias("field", "value"))
    one = fields.groupBy("to", "field").agg(F.min_by("value", "entity").alias("value"))
    pairs = F.filter(F.collect_list(F.struct("field", "value")), lambda p: p["field"].isNotNull())
    return one.groupBy("to").agg(F.map_from_entries(F.array_sort(pairs)).alias("record")).select(F.col("to").alias("entity"), "record")


def follow(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """Pairs (a, b) that follow their entities; those of one entity with itself are settled."""
    m = lambda c: merged.select(F.col("absorbed").alias(c), F.col("kept").alias(f"k{c}"))
    p = pairs.join(m("a"), "a", "left").join(m("b"), "b", "left")
    x, y = F.coalesce("ka", "a"), F.coalesce("kb", "b")
    return p.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def close_edges(edges: DataFrame, closures: DataFrame, spared: DataFrame) -> DataFrame:
    """Tombstones for every edge of a closure's (subject, predicate) in force at its instant, but for the triples spared; closures: (subject, predicate, at)."""
    live = edges.join(closures, ["subject", "predicate"]).where((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    last = live.groupBy(*TRIPLE, "at").agg(F.max_by("present", F.struct("tx", "seq")).alias("present")).where("present")
    return last.join(spared.select(*TRIPLE).distinct(), TRIPLE, "left_anti").select(*TRIPLE, F.col("at").alias("valid_from"))


def live_edges(edges: DataFrame, valid_t: int, tx_t: int) -> DataFrame:
    return in_force(edges, valid_t, tx_t)


def confirm(versions: DataFrame, edges: DataFrame, reviews: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions, edges and open reviews after merging absorbed entities into kept ones, given as roots.

    The kept entity's log comes first, so at equal tx the absorbed one's version wins.
    Reviews follow their entities; those of one entity with itself are settled, and of
    equal pairs the first stays.
    """
    moved = versions.join(merged.select(F.col("absorbed").alias("entity"), "kept"), "entity", "left")
    order = F.row_number().over(Window.partitionBy(F.coalesce("kept", "entity"), "attribute").orderBy(F.col("kept").isNotNull(), "entity", "seq")) - 1
    out = moved.withColumn("n", order.cast("long")).withColumn("entity", F.coalesce("kept", "entity")).withColumn("seq", F.col("n")).select(*versions.columns)
    m = lambda c: merged.select(F.col("absorbed").alias(c), F.col("kept").alias(f"k{c}"))
    r = reviews.join(m("a"), "a", "left").join(m("b"), "b", "left")
    x, y = F.coalesce("ka", "a"), F.coalesce("kb", "b")
    r = r.select("review", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "score").where("a <> b")
    first = F.row_number().over(Window.partitionBy("a", "b").orderBy("review"))
    return out, repoint_edges(edges, merged), r.withColumn("n", first).where("n = 1").drop("n")


def reject(reviews: DataFrame, rejected: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open reviews, rejected pairs (a, b)) after settling the given reviews as different."""
    gone = reviews.join(settled.select("review"), "review", "left_semi").select("a", "b")
    gone = gone.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return reviews.join(settled.select("review"), "review", "left_anti"), rejected.unionByName(gone).distinct()
