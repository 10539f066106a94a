"""Bi-temporal selection: among the versions known at tx_t and valid at valid_t, the last one learned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.functions.interval import contains
from bitempo.schema import LOG, TRIPLE


def as_of(versions: DataFrame, valid_t: int, tx_t: int, asked: DataFrame | None = None) -> DataFrame:
    """(entity, attribute, state, value) for each asked (entity, attribute), or each in the log."""
    asked = versions.select(*LOG).distinct() if asked is None else asked
    held = versions.where((F.col("tx") <= tx_t) & contains(valid_t)).groupBy(*LOG).agg(F.max_by(F.struct("state", "value"), F.struct("tx", "seq")).alias("top"))
    return asked.join(held, LOG, "left").select(*LOG, F.coalesce("top.state", F.lit("unknown")).alias("state"), F.col("top.value").alias("value"))


def as_of_join(probes: DataFrame, versions: DataFrame) -> DataFrame:
    """The answers to many questions (probe, entity, attribute, valid_t, tx_t) at once: an as-of join on two axes."""
    found = probes.join(versions, LOG).where((F.col("tx") <= F.col("tx_t")) & contains(F.col("valid_t"))).groupBy("probe").agg(F.max_by(F.struct("state", "value"), F.struct("tx", "seq")).alias("top"))
    return probes.join(found, "probe", "left").select(*probes.columns, F.coalesce("top.state", F.lit("unknown")).alias("state"), F.col("top.value").alias("value"))


def current(versions: DataFrame, now: int, asked: DataFrame | None = None) -> DataFrame:
    return as_of(versions, now, now, asked)


def history(versions: DataFrame, entity: int | None = None, attribute: str | None = None) -> DataFrame:
    """The log of an entity or attribute in append order; of all, in no order but that of seq within a log."""
    out = versions if entity is None else versions.where(F.col("entity") == entity)
    out = out if attribute is None else out.where(F.col("attribute") == attribute)
    return out.orderBy(*LOG, "seq") if entity is not None else out


def entity_ids(versions: DataFrame) -> DataFrame:
    """Ids; a caller that wants them ascending orders them."""
    return versions.select("entity").distinct()


def in_force(edges: DataFrame, valid_t: int, tx_t: int) -> DataFrame:
    """(subject, predicate, object) of the edges present in the last version learned; a tombstone has to win first."""
    last = edges.where((F.col("tx") <= tx_t) & contains(valid_t)).groupBy(*TRIPLE).agg(F.max_by("present", F.struct("tx", "seq")).alias("present"))
    return last.where("present").select(*TRIPLE)


def edges_from(edges: DataFrame, valid_t: int, tx_t: int, subject: int | None = None) -> DataFrame:
    some = edges if subject is None else edges.where(F.col("subject") == subject)
    found = in_force(some, valid_t, tx_t)
    return found if subject is None else found.orderBy("predicate", "object")


def edges_into(edges: DataFrame, valid_t: int, tx_t: int, object_: int | None = None) -> DataFrame:
    some = edges if object_ is None else edges.where(F.col("object") == object_)
    found = in_force(some, valid_t, tx_t).select("object", "subject", "predicate")
    return found if object_ is None else found.orderBy("subject", "predicate")


def edge_history(edges: DataFrame, subject: int | None = None, predicate: str | None = None, object_: int | None = None) -> DataFrame:
    """The log of a triple in append order; of all, in no order but that of seq within a log."""
    asked = [F.col(c) == v for c, v in zip(TRIPLE, (subject, predicate, object_), strict=True) if v is not None]
    for a in asked:
        edges = edges.where(a)
    return edges.orderBy(*TRIPLE, "seq") if asked else edges


def entity(entities: DataFrame, wanted: int) -> DataFrame:
    """The row of one entity, or none."""
    return entities.where(F.col("entity") == wanted)


def is_known(state: str = "state") -> Column:
    """Whether an answer says something: a value, or that there is none."""
    return F.col(state).isin("value", "absent")


def value_of(state: str = "state", value: str = "value") -> Column:
    """An answer's value; absent and unknown have none."""
    return F.when(F.col(state) == "value", F.col(value))
