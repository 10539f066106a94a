"""What the command line and the tool server do: each command over a store, as plain data.

remember, recall, about, reviews, confirm and reject return dictionaries; ``words``
puts them into sentences that keep the four states of an answer apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bitempo.config import Config
from bitempo.operators import recall as R
from bitempo.operators import survivorship, vector
from bitempo.operators.memory import Memory
from bitempo.sources.storage import Snapshots
from bitempo.streaming.ingest import ingest


def recall(memory: Memory, query: R.Query, embedding: list[float], spark: SparkSession) -> list[dict]:
    asked = spark.createDataFrame([(0, embedding)], "query_id long, vector array<double>")
    bad = asked.select(vector.problems("vector", memory.dim, memory.metric).alias("why")).first()["why"]
    if bad:
        raise ValueError(bad)
    hits = R.recall(memory.versions, memory.vectors, asked, query, memory.dim, memory.metric).orderBy("rank")
    return [{k: v for k, v in r.asDict().items() if k != "query_id"} for r in hits.collect()]


class Session:
    """A store, its configuration and the two models."""

    def __init__(self, spark: SparkSession, store: Snapshots, config: Config, completer: Callable[[str, str | None], str], embedder: Callable[[str], list[float]]):
        self.spark, self.store, self.config, self.completer, self.embedder = spark, store, config, completer, embedder

    def memory(self) -> Memory:
        return self.store.open(self.config.dim, self.config.metric)

    def remember(self, text: str, now: int, session: int | str = 0, speaker: str | None = None) -> dict:
        """The turn's mentions with the entities they landed on, what was written and what was dropped."""
        memory = self.memory()
        turn = self.spark.createDataFrame([(str(session), 0, speaker, text, now)], "session string, position long, speaker string, text string, observed_at long")
        turn = turn.withColumn("position", F.lit(now))  # a session's turns are in the order of their instants
        before = memory.versions.count()
        got = ingest(turn, self.completer, self.config.ruleset, memory, self.embedder)
        self.store.save(got.memory)
        landed = [{"entity": r.entity, "name": r.name, "kind": r.kind, "outcome": r.outcome} for r in got.told.orderBy("item").collect()]
        return {"mentions": landed, "versions": self.memory().versions.count() - before, "dropped": [r.why for r in got.dropped.collect()], "reviews": [r.review for r in got.reviews.orderBy("review").collect()]}

    def recall(self, text: str, query: R.Query) -> list[dict]:
        return recall(self.memory(), query, self.embedder(text), self.spark)

    def about(self, entity: int, attribute: str, valid_t: int, tx_t: int) -> dict:
        log = self.memory().versions.where((F.col("entity") == entity) & (F.col("attribute") == attribute))
        row = survivorship.about(log, self.config.policy, valid_t, tx_t).first()
        return {"state": row["state"], "value": row["value"], "reason": row["reason"]} if row else {"state": "unknown", "value": None, "reason": None}

    def reviews(self) -> list[dict]:
        return [r.asDict() for r in self.memory().named_reviews().orderBy("review").collect()]

    def settle(self, review: int, same: bool) -> dict:
        memory = self.memory()
        pair = memory.reviews.where(F.col("review") == review).first()
        if pair is None:
            raise ValueError(f"no open review {review}")
        settled = self.spark.createDataFrame([(review,)], "review long")
        self.store.save(memory.confirm(settled) if same else memory.reject(settled))
        return {"survivor": min(pair.a, pair.b)} if same else {"different": [pair.a, pair.b]}


def words(state: str, value: str | None, reason: str | None) -> str:
    """The four states in words."""
    return {"value": f"{value}", "absent": "known to have none", "unknown": "never discussed", "refused": f"refused to guess: {reason}"}[state]


def hit_line(h: dict) -> str:
    said = h["value"] if h["state"] == "value" else "known to have none"
    return f"{h['entity']} {h['attribute']}: {said} ({h['score']:.3f}){' superseded' if h['superseded'] else ''}"


def review_line(r: dict) -> str:
    return f"{r['review']}: {r['a_name']} ({r['a_kind']}, {r['a']}) and {r['b_name']} ({r['b_kind']}, {r['b']}), {r['score']:.2f} bits"
