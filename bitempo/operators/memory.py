"""A memory's tables as one bundle, and the writes that keep them together.

entities    entity, kind, created_at
versions    the log, with the assertion_id of those that have a vector
edges       subject, predicate, object, seq, present, valid_from, valid_to, tx
identity    entity, record
vectors     assertion_id, vector
reviews     review, a, b, score
rejected    a, b

Every function returns a new bundle; nothing is edited in place.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.operators import mutations, vector
from bitempo.operators.mutations import UnknownEntity
from bitempo.plans.numbering import number
from bitempo.schema import LOG

SCHEMAS = {
    "entities": "entity long, kind string, created_at long",
    "versions": "entity long, attribute string, seq long, state string, value string, valid_from long, valid_to long, tx long, source string, session string, assertion_id long",
    "edges": "subject long, predicate string, object long, seq long, present boolean, valid_from long, valid_to long, tx long, source string, session string, because string",
    "identity": "entity long, record map<string,string>",
    "vectors": "assertion_id long, vector array<double>",
    "reviews": "review long, a long, b long, score double",
    "rejected": "a long, b long",
}


@dataclass(frozen=True)
class Memory:
    entities: DataFrame
    versions: DataFrame
    edges: DataFrame
    identity: DataFrame
    vectors: DataFrame
    reviews: DataFrame
    rejected: DataFrame
    dim: int = 64
    metric: str = "cosine"

    @staticmethod
    def empty(spark: SparkSession, dim: int = 64, metric: str = "cosine") -> Memory:
        return Memory(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}, dim=dim, metric=metric)

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in SCHEMAS}

    # inspection

    def entity_count(self) -> int:
        """Entities that resolution knows; those absorbed by a merge are none."""
        return self.identity.count()

    def entity_ids(self) -> DataFrame:
        return self.identity.select("entity")

    def identity_of(self, entity: int) -> DataFrame:
        return self.identity.where(F.col("entity") == entity)

    def pending_review(self) -> DataFrame:
        return self.reviews.orderBy("review")

    def assertion(self, assertion_id: int) -> DataFrame:
        return self.versions.where(F.col("assertion_id") == assertion_id)

    def index(self) -> vector.Index:
        return vector.Index(self.vectors, self.dim, self.metric)

    def index_len(self) -> int:
        return len(self.index())

    def index_shape(self) -> tuple[int, str]:
        return self.dim, self.metric

    def named_reviews(self) -> DataFrame:
        """(review, a, a_name, a_kind, b, b_name, b_kind, score): the open questions with names, and kinds as last stated."""
        kinds = self.versions.where("attribute = 'kind'").groupBy("entity").agg(F.max_by("value", "seq").alias("kind"))
        who = self.identity.select("entity", F.col("record")["name"].alias("name")).join(kinds, "entity", "left").select("entity", "name", F.coalesce("kind", F.lit("?")).alias("kind"))
        side = lambda c: who.select(F.col("entity").alias(c), F.col("name").alias(f"{c}_name"), F.col("kind").alias(f"{c}_kind"))
        return self.reviews.join(side("a"), "a", "left").join(side("b"), "b", "left").select("review", "a", "a_name", "a_kind", "b", "b_name", "b_kind", "score")

    # writes

    def create(self, new: DataFrame, order: list[str]) -> Memory:
        """Entities (record, kind, created_at and the columns of order) with the next ids in that order: stored and known to resolution."""
        rows = number(new, order, "entity", _next(self.entities, "entity"))
        return replace(self, entities=self.entities.unionByName(rows.select("entity", "kind", "created_at")), identity=self.identity.unionByName(rows.select("entity", "record")))

    def write(self, rows: DataFrame, order: list[str]) -> Memory:
        """Versions, vectors and assertions together: rows (entity, attribute, state, value, valid_from, valid_to, tx, source, session, vector), with the next assertion ids in the given order. Nothing is written if an entity is unknown or a vector cannot be stored."""
        mutations.require_entities(rows, self.entities)
        bad = rows.withColumn("why", vector.problems("vector", self.dim, self.metric)).where("why is not null").select("why").first()
        if bad:
            raise ValueError(bad["why"])
        told = number(rows, order, "assertion_id", _next(self.vectors, "assertion_id")).withColumn("seq", F.col("assertion_id"))
        versions = mutations.append(self.versions, told, LOG)
        kept = vector.prepare(told.select("assertion_id", "vector"), self.dim, self.metric)
        return replace(self, versions=versions, vectors=self.vectors.unionByName(kept))

    def forget(self, gone: DataFrame, at: int, source: str, session: str) -> Memory:
        """A tombstone behind each log, and its vectors gone: recall is silent, history answers."""
        mutations.require_entities(gone, self.entities)
        versions, _ = mutations.forget_attribute(self.versions, self.versions, gone, at, source, session)
        return replace(self, versions=versions, vectors=self._without(gone))

    def erase(self, gone: DataFrame) -> tuple[Memory, DataFrame]:
        """(memory without the logs and their vectors, (entity, attribute, erased)); an unknown entity is an error."""
        mutations.require_entities(gone, self.entities)
        versions, lost = mutations.erase_attribute(self.versions, gone)
        return replace(self, versions=versions, vectors=self._without(gone)), lost

    def erase_edges(self, gone: DataFrame) -> tuple[Memory, DataFrame]:
        mutations.require_entities(gone, self.entities)
        edges, lost = mutations.erase_edges(self.edges, gone)
        return replace(self, edges=edges), lost

    def _without(self, gone: DataFrame) -> DataFrame:
        dropped = self.versions.join(gone.select(*LOG).distinct(), LOG, "left_semi").where("assertion_id is not null").select("assertion_id")
        return vector.remove(self.vectors, dropped)

    def confirm(self, settled: DataFrame) -> Memory:
        """Reviews (review) answered with "the same": the smaller id survives, chains end at their smallest. Logs follow, the survivor's own first; assertions keep their ids and so their vectors; edges, identity, open reviews and rejected pairs name the survivor."""
        unknown = settled.join(self.reviews, "review", "left_anti").limit(1).collect()
        if unknown:
            raise UnknownEntity(f"no review {unknown[0][0]}")
        merged = mutations.roots(self.reviews.join(settled.select("review"), "review", "left_semi").select(F.col("b").alias("absorbed"), F.col("a").alias("kept")))
        versions, edges, reviews = mutations.confirm(self.versions, self.edges, self.reviews.join(settled.select("review"), "review", "left_anti"), merged)
        return replace(self, versions=versions, edges=edges, reviews=reviews, identity=mutations.fold_identity(self.identity, merged), rejected=mutations.follow(self.rejected, merged))

    def reject(self, settled: DataFrame) -> Memory:
        """Reviews (review) answered with "different": they close, and the pair is not asked about again."""
        reviews, rejected = mutations.reject(self.reviews, self.rejected, settled)
        return replace(self, reviews=reviews, rejected=rejected)


def _next(df: DataFrame, column: str) -> int:
    top = df.agg(F.max(column)).first()[0]
    return 1 if top is None else top + 1
