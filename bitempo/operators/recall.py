"""Recall: the k nearest assertions within a scope, joined back to their versions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.functions.interval import contains
from bitempo.operators import vector
from bitempo.schema import LOG


@dataclass(frozen=True)
class Query:
    """What to recall. Without as_of, both axes are unbounded; the engine has no clock."""

    k: int = 5
    at: tuple[int, int] | None = None
    entity: int | None = None
    session: str | None = None
    source: str | None = None

    def as_of(self, valid_t: int, tx_t: int) -> Query:
        return replace(self, at=(valid_t, tx_t))

    def about_entity(self, entity: int) -> Query:
        return replace(self, entity=entity)

    def in_session(self, session: str) -> Query:
        return replace(self, session=session)

    def from_source(self, source: str) -> Query:
        return replace(self, source=source)

    def scope(self) -> Column:
        """Which versions may be hits; it is applied before any is scored."""
        out = F.lit(True)
        for name in ("entity", "session", "source"):
            wanted = getattr(self, name)
            if wanted is not None:
                out &= F.col(name) == wanted
        if self.at is not None:
            out &= (F.col("tx") <= self.at[1]) & contains(self.at[0])
        return out


def recall(versions: DataFrame, vectors: DataFrame, asked: DataFrame, query: Query, dim: int, metric: str = "cosine", match: list[str] | None = None) -> DataFrame:
    """(query_id, rank, assertion_id, score, entity, attribute, state, value, valid_from, valid_to, tx, source, session, superseded).

    versions carry the assertion_id of those that have a vector; asked: (query_id,
    vector). superseded: a strictly later version of the log was learned by the query's
    tx_t, whatever it says; such hits are told, not left out. match: columns in which a
    hit equals its query.
    """
    told = versions.where(F.col("assertion_id").isNotNull()).where(query.scope())
    rows = vectors.select("assertion_id", "vector").join(told.select("assertion_id", *(match or [])), "assertion_id")
    hits = vector.search(rows, vector.prepare(asked, dim, metric), query.k, metric, match)
    known = versions if query.at is None else versions.where(F.col("tx") <= query.at[1])
    last = known.groupBy(*LOG).agg(F.max("tx").alias("last"))
    said = versions.select("assertion_id", *LOG, "state", "value", "valid_from", "valid_to", "tx", "source", "session")
    out = hits.join(said, "assertion_id").join(last, LOG, "left")
    return out.select("query_id", "rank", "assertion_id", "score", *LOG, "state", "value", "valid_from", "valid_to", "tx", "source", "session", F.coalesce(F.col("last") > F.col("tx"), F.lit(False)).alias("superseded"))
