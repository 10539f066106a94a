"""Survivorship: which assertion of an (entity, attribute) log stands, decided when it is read.

Every strategy is one grouped aggregation, and answers (state, value, reason). Where
all assertions agree, that is the answer under any strategy. Silence is an empty log.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitempo.schema import LOG


class Strategy(Enum):
    MOST_COMPLETE = "most_complete"
    LONGEST_VALUE = "longest_value"
    MAJORITY_VOTE = "majority_vote"
    CONFIDENCE_MAJORITY = "confidence_majority"
    FIRST_NON_NULL = "first_non_null"
    UNANIMOUS_OR_NULL = "unanimous_or_null"
    MOST_RECENT = "most_recent"
    SOURCE_PRIORITY = "source_priority"
    VALID_INTERVAL = "valid_interval"

    @property
    def needs_provenance(self) -> bool:
        return self in (Strategy.MOST_RECENT, Strategy.SOURCE_PRIORITY, Strategy.VALID_INTERVAL)


@dataclass(frozen=True)
class Policy:
    """A default strategy, and others for some attributes."""

    default: Strategy = Strategy.MOST_RECENT
    overrides: dict[str, Strategy] = field(default_factory=dict)
    priority: tuple[str, ...] = ()

    def for_attribute(self, attribute: str) -> Strategy:
        return self.overrides.get(attribute, self.default)


TIE = "contradictory values at the same instant"


def _answer(df: DataFrame, top: Column, reason: Column | None = None) -> DataFrame:
    reason = F.lit(None).cast("string") if reason is None else reason
    agreed = F.col("kinds") == 1
    why = F.when(~agreed, reason)
    t = F.when(agreed, F.col("any")).otherwise(top)
    state = F.when(why.isNotNull(), "refused").otherwise(F.coalesce(t["state"], F.lit("unknown")))
    return df.select(*LOG, state.alias("state"), F.when(why.isNull(), t["value"]).alias("value"), why.alias("reason"))


def _held() -> Column:
    return F.struct("state", "value")


def _common() -> list[Column]:
    return [F.count_distinct(_held()).alias("kinds"), F.min_by(_held(), "seq").alias("any")]


def longest(log: DataFrame) -> DataFrame:
    """Most characters; an absent one has none; of equals the first seen."""
    size = F.struct(F.coalesce(F.char_length("value"), F.lit(0)).alias("n"), (-F.col("seq")).alias("back"))
    return _answer(log.groupBy(*LOG).agg(*_common(), F.max_by(_held(), size).alias("top")), F.col("top"))


def plurality(log: DataFrame) -> DataFrame:
    """Most votes; of equals the value whose first appearance is earliest. Absent votes too."""
    votes = log.groupBy(*LOG, "state", "value").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    agg = votes.groupBy(*LOG).agg(F.count("*").alias("kinds"), F.min_by(_held(), "first").alias("any"), F.max_by(_held(), F.struct(F.col("n"), (-F.col("first")).alias("back"))).alias("top"))
    return _answer(agg, F.col("top"))


def first_non_null(log: DataFrame) -> DataFrame:
    """The first assertion; an absent one counts."""
    return _answer(log.groupBy(*LOG).agg(*_common()), F.col("any"))


def unanimous(log: DataFrame) -> DataFrame:
    """The value all agree on, else unknown."""
    return _answer(log.groupBy(*LOG).agg(*_common()), F.lit(None).cast("struct<state:string,value:string>"))


def most_recent(log: DataFrame) -> DataFrame:
    """The last learned; refused where the last instant holds different values."""
    instants = log.groupBy(*LOG, "tx").agg(*_common())
    top = F.max_by(F.struct("any", "kinds"), "tx")
    agg = instants.groupBy(*LOG).agg(top.alias("last"), F.max("kinds").alias("most"), F.count_distinct("any").alias("others"), F.min_by("any", "tx").alias("any"))
    agg = agg.withColumn("kinds", F.when((F.col("most") == 1) & (F.col("others") == 1), 1).otherwise(2))
    return _answer(agg, F.col("last.any"), F.when(F.col("last.kinds") > 1, TIE))


def source_priority(log: DataFrame, order: list[str]) -> DataFrame:
    """The last learned from the first source in the order that asserts anything; refused with an empty order, or where an asserting source is not in it."""
    rank = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(order))):
        rank = F.when(F.col("source") == s, i).otherwise(rank)
    ranked = log.withColumn("rank", rank)
    all_ = ranked.groupBy(*LOG).agg(*_common(), F.count_if(F.col("rank").isNull()).alias("strangers"), F.min("rank").alias("rank"))
    tier = most_recent(ranked.join(all_.select(*LOG, F.col("rank")), [*LOG, "rank"], "left_semi")).select(*LOG, F.struct("state", "value").alias("top"), F.col("reason").alias("tie"))
    reason = F.when(F.lit(not order), "no source order").when(F.col("strangers") > 0, "a source is not in the order").otherwise(F.col("tie"))
    return _answer(all_.join(tier, LOG, "left"), F.col("top"), reason)


def timeline(log: DataFrame) -> DataFrame:
    """(entity, attribute, state, value, opens, closes, reason): spans between changes by instant of learning, restated values extending theirs; one refused row where an instant holds different values."""
    instants = log.groupBy(*LOG, "tx").agg(*_common())
    w = Window.partitionBy(*LOG)
    bad = F.max("kinds").over(w) > 1
    by = w.orderBy("tx")
    marked = instants.select(*LOG, "tx", F.col("any").alias("held"), bad.alias("bad"), F.lag("any").over(by).alias("before"), F.row_number().over(by).alias("n"))
    opens = marked.where(F.when(F.col("bad"), F.col("n") == 1).otherwise((F.col("n") == 1) | ~F.col("held").eqNullSafe(F.col("before"))))
    out = opens.withColumn("closes", F.lead("tx").over(by))
    ok = ~F.col("bad")
    return out.select(*LOG, F.when(ok, F.col("held.state")).otherwise("refused").alias("state"), F.when(ok, F.col("held.value")).alias("value"), F.when(ok, F.col("tx")).alias("opens"), F.when(ok, F.col("closes")).alias("closes"), F.when(~ok, TIE).alias("reason"))


def merge(log: DataFrame, strategy: Strategy, order: list[str] | None = None) -> DataFrame:
    """Each log's outcome under a strategy with a single survivor."""
    run = {Strategy.MOST_COMPLETE: longest, Strategy.LONGEST_VALUE: longest, Strategy.MAJORITY_VOTE: plurality, Strategy.CONFIDENCE_MAJORITY: plurality, Strategy.FIRST_NON_NULL: first_non_null, Strategy.UNANIMOUS_OR_NULL: unanimous, Strategy.MOST_RECENT: most_recent}
    return source_priority(log, order or []) if strategy is Strategy.SOURCE_PRIORITY else run[strategy](log)


def held_at(log: DataFrame, strategy: Strategy, t: int, order: list[str] | None = None) -> DataFrame:
    """What each log holds at t: a survivor at every t, a timeline in its spans."""
    if strategy is not Strategy.VALID_INTERVAL:
        return merge(log, strategy, order)
    spans = timeline(log)
    now = spans.where((F.col("state") == "refused") | ((F.col("opens") <= t) & (F.col("closes").isNull() | (F.lit(t) < F.col("closes")))))
    return log.select(*LOG).distinct().join(now.select(*LOG, "state", "value", "reason"), LOG, "left").select(*LOG, F.coalesce("state", F.lit("unknown")).alias("state"), "value", "reason")


def about(versions: DataFrame, policy: Policy, valid_t: int, tx_t: int) -> DataFrame:
    """What is believed of each (entity, attribute) in the log under the policy, from what was learned by tx_t; a version's own valid time plays no part."""
    asked = versions.select(*LOG).distinct()
    known = versions.where(F.col("tx") <= tx_t)
    special = list(policy.overrides)
    parts = [held_at(known.where(~F.col("attribute").isin(special)) if special else known, policy.default, valid_t, list(policy.priority))]
    for strategy in dict.fromkeys(policy.overrides.values()):
        own = [a for a, s in policy.overrides.items() if s is strategy]
        parts.append(held_at(known.where(F.col("attribute").isin(own)), strategy, valid_t, list(policy.priority)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return asked.join(out, LOG, "left").select(*LOG, F.coalesce("state", F.lit("unknown")).alias("state"), "value", "reason")


def assert_resolved(log: DataFrame, strategy: Strategy, order: list[str] | None = None) -> DataFrame:
    """The versions that resolving and writing the outcome would append: (entity, attribute, state, value, valid_from, valid_to, tx, seq)."""
    if strategy is Strategy.VALID_INTERVAL:
        spans = timeline(log).where("state <> 'refused'")
        last = log.groupBy(*LOG).agg(F.max(F.struct("tx", "seq")).alias("last"))
        return spans.join(last, LOG).select(*LOG, "state", "value", F.col("opens").alias("valid_from"), F.col("closes").alias("valid_to"), "last.tx", "last.seq")
    ends = log.groupBy(*LOG).agg(F.min("tx").alias("valid_from"), F.max(F.struct("tx", "seq")).alias("last"))
    won = merge(log, strategy, order).where(F.col("state").isin("value", "absent"))
    return won.join(ends, LOG).select(*LOG, "state", "value", "valid_from", F.lit(None).cast("long").alias("valid_to"), "last.tx", "last.seq")


def superseded(versions: DataFrame, horizon: int | None = None) -> DataFrame:
    """versions with whether a strictly later one of the same log was learned by the horizon, whatever its value."""
    tx = F.col("tx") if horizon is None else F.when(F.col("tx") <= horizon, F.col("tx"))
    return versions.withColumn("superseded", F.coalesce(F.max(tx).over(Window.partitionBy(*LOG)) > F.col("tx"), F.lit(False)))


def outcome_as_of(log: DataFrame, strategy: Strategy, t: int, order: list[str] | None = None) -> DataFrame:
    """(entity, attribute, value) held at t; an absence, asserted or not, is null, and refused logs have no row."""
    held = held_at(log, strategy, t, order)
    return held.where("state <> 'refused'").select(*LOG, F.when(F.col("state") == "value", F.col("value")).alias("value"))


def survivor(log: DataFrame, strategy: Strategy, order: list[str] | None = None) -> DataFrame:
    """(entity, attribute, value) of the single winner; a timeline has one only if it is a single fact. Refused logs have no row."""
    if strategy is not Strategy.VALID_INTERVAL:
        return outcome_as_of(log, strategy, 0, order)
    spans = timeline(log).groupBy(*LOG).agg(F.count("*").alias("n"), F.min(F.struct("state", "value")).alias("one"))
    return spans.where("one.state <> 'refused'").select(*LOG, F.when((F.col("n") == 1) & (F.col("one.state") == "value"), F.col("one.value")).alias("value"))
