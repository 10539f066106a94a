"""Registered queries of the memory engine, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.functions import text as T
from bitempo.functions.interval import between, contains, is_empty, provenance, since
from bitempo.operators import analytics, extract, graph, mutations, remember, resolve, survivorship, temporal, vector
from bitempo.operators.memory import Memory
from bitempo.operators.recall import Query, recall
from bitempo.operators.survivorship import Policy, Strategy
from bitempo.sources import integrity, views

#: The instants at which events and orders are asked about.
VALID_T, TX_T = 1704931200000, 1705536000000
MID = 893462400000
SOURCES = ["user_assertion", "tool_output", "agent_inference"]

VO = "vo AS (SELECT o_custkey AS entity, 'order_status' AS attribute, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 'absent' ELSE 'value' END AS state, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS value, epoch_us(o_orderdate)//1000 AS valid_from, CAST(NULL AS BIGINT) AS valid_to, epoch_us(o_orderdate)//1000 AS tx, 'user_assertion' AS source FROM orders)"
VE = "ve AS (SELECT user_id AS entity, 'activity' AS attribute, event_id AS seq, CASE WHEN event_type = 'error' THEN 'absent' ELSE 'value' END AS state, CASE WHEN event_type <> 'error' THEN event_type END AS value, epoch_us(ts)//1000 - CAST(json_extract_string(props, '$.k') AS BIGINT) * 86400000 AS valid_from, CAST(NULL AS BIGINT) AS valid_to, epoch_us(ts)//1000 AS tx, CASE WHEN event_type IN ('click','view') THEN 'tool_output' WHEN event_type = 'error' THEN 'agent_inference' ELSE 'user_assertion' END AS source, strftime(ts, '%Y-%m-%d') AS session FROM events)"
SHIP = "ship AS (SELECT l_partkey AS p, l_suppkey AS s, min(epoch_us(l_shipdate)//1000) AS first, min(CASE WHEN l_returnflag = 'R' THEN epoch_us(l_shipdate)//1000 END) AS returned FROM lineitem GROUP BY 1, 2)"
EDGES = f"""{SHIP}, e AS (
  SELECT n_nationkey + 1000 AS subject, 'in_region' AS predicate, CAST(n_regionkey AS BIGINT) AS object, 0 AS seq, true AS present, 0 AS valid_from, 0 AS tx FROM nation
  UNION ALL SELECT c_custkey + 10000000, 'in_nation', c_nationkey + 1000, 0, true, 0, 0 FROM customer
  UNION ALL SELECT s_suppkey + 100000, 'in_nation', s_nationkey + 1000, 0, true, 0, 0 FROM supplier
  UNION ALL SELECT o_orderkey + 1000000000, 'placed_by', o_custkey + 10000000, 0, true, epoch_us(o_orderdate)//1000, epoch_us(o_orderdate)//1000 FROM orders
  UNION ALL SELECT p + 20000000, 'supplied_by', s + 100000, 0, true, first, first FROM ship
  UNION ALL SELECT p + 20000000, 'supplied_by', s + 100000, 1, false, returned, returned + 86400000 FROM ship WHERE returned IS NOT NULL)"""
FORCE = "f AS (SELECT subject, predicate, object FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY tx DESC, seq DESC) AS r FROM e WHERE tx <= {tx} AND valid_from <= {valid}) WHERE r = 1 AND present)"
LAST_EDGE = 10**13

Q: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        Q[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# intervals and selection


@query(f"WITH {VE} SELECT entity, seq, valid_from, tx AS valid_to, (valid_from <= {VALID_T} AND {VALID_T} < tx) AS covers FROM ve")
def interval_contains(spark: SparkSession, d: str) -> DataFrame:
    v = views.event_versions(spark, d).withColumn("valid_to", F.col("tx"))
    return v.select("entity", "seq", "valid_from", "valid_to", contains(VALID_T).alias("covers"))


@query(f"WITH {VE} SELECT entity, seq, (tx <= valid_from) AS empty FROM ve")
def interval_is_empty(spark, d):
    return views.event_versions(spark, d).withColumn("valid_to", F.col("tx")).select("entity", "seq", is_empty().alias("empty"))


@query(f"WITH {VE} SELECT entity, seq, (valid_from <= {VALID_T}) AS open_covers, (valid_from <= {VALID_T} AND {VALID_T} < tx) AS closed_covers, (tx <= valid_from) AS closed_empty FROM ve")
def interval_since_between(spark, d):
    """An interval without an end and one up to the instant of learning, of each version."""
    v = views.event_versions(spark, d)
    (a, b), (x, y) = since(F.col("valid_from")), between(F.col("valid_from"), F.col("tx"))
    v = v.select("entity", "seq", a.alias("a"), b.alias("b"), x.alias("x"), y.alias("y"))
    return v.select("entity", "seq", contains(VALID_T, "a", "b").alias("open_covers"), contains(VALID_T, "x", "y").alias("closed_covers"), is_empty("x", "y").alias("closed_empty"))


@query(f"WITH {VE} SELECT source, count(*) AS versions, min(tx) AS first, max(tx) AS last, count(DISTINCT session) AS refs FROM ve GROUP BY 1")
def provenance_by_source(spark, d):
    v = views.event_versions(spark, d).select(provenance(F.col("source"), F.col("tx"), F.col("session")).alias("p"))
    return v.groupBy(F.col("p.source").alias("source")).agg(F.count("*").alias("versions"), F.min("p.observed_at").alias("first"), F.max("p.observed_at").alias("last"), F.countDistinct("p.source_ref").alias("refs"))


def _as_of_sql(view: str, cte: str, valid: int, tx: int) -> str:
    return f"WITH {cte}, top AS (SELECT entity, attribute, state, value FROM (SELECT *, row_number() OVER (PARTITION BY entity, attribute ORDER BY tx DESC, seq DESC) AS r FROM {view} WHERE tx <= {tx} AND valid_from <= {valid} AND (valid_to IS NULL OR {valid} < valid_to)) WHERE r = 1) SELECT k.entity, k.attribute, coalesce(top.state, 'unknown') AS state, top.value FROM (SELECT DISTINCT entity, attribute FROM {view}) k LEFT JOIN top ON k.entity = top.entity AND k.attribute = top.attribute"


@query(_as_of_sql("ve", VE, VALID_T, TX_T))
def as_of_attribute(spark, d):
    return temporal.as_of(views.event_versions(spark, d), VALID_T, TX_T)


@query(_as_of_sql("vo", VO, MID, MID))
def current_attribute(spark, d):
    return temporal.current(views.order_versions(spark, d), MID)


@query(f"WITH {VE}, p AS (SELECT DISTINCT entity * 10 + k AS probe, entity, attribute, {VALID_T} + k * 86400000 AS valid_t, {TX_T} + k * 43200000 AS tx_t FROM ve, range(3) r(k)), b AS (SELECT probe, state, value, row_number() OVER (PARTITION BY probe ORDER BY tx DESC, seq DESC) AS r FROM p JOIN ve USING (entity, attribute) WHERE tx <= tx_t AND valid_from <= valid_t) SELECT p.probe, p.entity, p.attribute, p.valid_t, p.tx_t, coalesce(b.state, 'unknown') AS state, b.value FROM p LEFT JOIN b ON p.probe = b.probe AND b.r = 1")
def as_of_join(spark, d):
    v = views.event_versions(spark, d)
    k = F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)]))
    p = v.select("entity", "attribute").distinct().withColumn("k", k).select((F.col("entity") * 10 + F.col("k")).alias("probe"), "entity", "attribute", (F.col("k") * 86400000 + VALID_T).alias("valid_t"), (F.col("k") * 43200000 + TX_T).alias("tx_t"))
    return temporal.as_of_join(p, v)


@query(f"WITH {VE} SELECT entity, attribute, seq, state, value, valid_from, tx, source, session FROM ve")
def history_log(spark, d):
    return temporal.history(views.event_versions(spark, d)).drop("valid_to")


@query(f"WITH {VO} SELECT DISTINCT entity FROM vo")
def entity_ids(spark, d):
    return temporal.entity_ids(views.order_versions(spark, d))


@query(f"WITH {EDGES}, {FORCE.format(valid=MID, tx=MID)} SELECT * FROM f")
def edges_from(spark, d):
    return temporal.edges_from(views.edge_versions(spark, d), MID, MID)


@query(f"WITH {EDGES}, {FORCE.format(valid=MID, tx=LAST_EDGE)} SELECT object, subject, predicate FROM f")
def edges_into(spark, d):
    return temporal.edges_into(views.edge_versions(spark, d), MID, LAST_EDGE)


@query(f"WITH {EDGES} SELECT subject, predicate, object, CAST(seq AS BIGINT) AS seq, present, valid_from, tx FROM e")
def edge_history(spark, d):
    return temporal.edge_history(views.edge_versions(spark, d)).drop("valid_to")


@query(f"WITH {EDGES}, {FORCE.format(valid=LAST_EDGE, tx=LAST_EDGE)} SELECT predicate, count(*) AS edges FROM f GROUP BY 1")
def edges_in_force_after_unrelate(spark, d):
    return temporal.in_force(views.edge_versions(spark, d), LAST_EDGE, LAST_EDGE).groupBy("predicate").agg(F.count("*").alias("edges"))


# survivorship

HELD = "coalesce(value, '~') || '/' || state"
KINDS = f"k AS (SELECT entity, attribute, count(DISTINCT {HELD}) AS kinds FROM vo GROUP BY 1, 2)"


def _first_sql(order: str) -> str:
    return f"WITH {VO} SELECT entity, attribute, state, value, CAST(NULL AS VARCHAR) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY entity, attribute ORDER BY {order}) AS r FROM vo) WHERE r = 1"


@query(_first_sql("coalesce(length(value), 0) DESC, seq"))
def survivor_longest(spark, d):
    return survivorship.longest(views.order_versions(spark, d))


@query(f"WITH {VO}, c AS (SELECT entity, attribute, state, value, count(*) AS n, min(seq) AS s FROM vo GROUP BY 1, 2, 3, 4) SELECT entity, attribute, state, value, CAST(NULL AS VARCHAR) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY entity, attribute ORDER BY n DESC, s) AS r FROM c) WHERE r = 1")
def survivor_majority(spark, d):
    return survivorship.plurality(views.order_versions(spark, d))


@query(_first_sql("seq"))
def survivor_first(spark, d):
    return survivorship.first_non_null(views.order_versions(spark, d))


@query(f"WITH {VO}, {KINDS} SELECT k.entity, k.attribute, CASE WHEN kinds = 1 THEN x.state ELSE 'unknown' END AS state, CASE WHEN kinds = 1 THEN x.value END AS value, CAST(NULL AS VARCHAR) AS reason FROM k JOIN (SELECT entity, min(state) AS state, min(value) AS value FROM vo GROUP BY 1) x ON k.entity = x.entity")
def survivor_unanimous(spark, d):
    return survivorship.unanimous(views.order_versions(spark, d))


def _recent(view: str, where: str = "true") -> str:
    """(entity, attribute, state, value, reason) of the last learned."""
    return f"SELECT entity, attribute, CASE WHEN n > 1 THEN 'refused' ELSE state END AS state, CASE WHEN n = 1 THEN value END AS value, CASE WHEN n > 1 THEN '{survivorship.TIE}' END AS reason FROM (SELECT entity, attribute, min(state) AS state, min(value) AS value, count(DISTINCT {HELD}) AS n FROM (SELECT *, max(tx) OVER (PARTITION BY entity, attribute) AS last FROM {view} WHERE {where}) WHERE tx = last GROUP BY 1, 2)"


@query(f"WITH {VO} {_recent('vo')}")
def survivor_most_recent(spark, d):
    return survivorship.most_recent(views.order_versions(spark, d))


def _priority(order: list[str]) -> str:
    rank = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(order))
    return f"WITH {VE}, r AS (SELECT *, CASE source {rank} END AS rank FROM ve), a AS (SELECT entity, attribute, count(DISTINCT {HELD}) AS kinds, count(*) - count(rank) AS strangers, min(rank) AS best, min(state) AS s1, min(value) AS v1 FROM r GROUP BY 1, 2), t AS (SELECT r.* FROM r JOIN a ON r.entity = a.entity AND r.rank = a.best), m AS ({_recent('t')}) SELECT a.entity, a.attribute, CASE WHEN kinds = 1 THEN s1 WHEN strangers > 0 THEN 'refused' ELSE m.state END AS state, CASE WHEN kinds = 1 THEN v1 WHEN strangers > 0 THEN NULL ELSE m.value END AS value, CASE WHEN kinds = 1 THEN NULL WHEN strangers > 0 THEN 'a source is not in the order' ELSE m.reason END AS reason FROM a LEFT JOIN m ON a.entity = m.entity"


@query(_priority(SOURCES))
def survivor_source_priority(spark, d):
    return survivorship.source_priority(views.event_versions(spark, d), SOURCES)


@query(_priority(SOURCES[:2]))
def survivor_source_missing(spark, d):
    return survivorship.source_priority(views.event_versions(spark, d), SOURCES[:2])


def _timeline(view: str, where: str = "true") -> str:
    return f"i AS (SELECT entity, attribute, tx, min(state) AS state, min(value) AS value, count(DISTINCT {HELD}) AS n FROM {view} WHERE {where} GROUP BY 1, 2, 3), b AS (SELECT entity, attribute, max(n) > 1 AS bad FROM i GROUP BY 1, 2), g AS (SELECT i.*, lag(state || coalesce(value, '~')) OVER (PARTITION BY i.entity, i.attribute ORDER BY tx) AS before FROM i JOIN b ON i.entity = b.entity AND i.attribute = b.attribute WHERE NOT bad), o AS (SELECT entity, attribute, state, value, tx AS opens, lead(tx) OVER (PARTITION BY entity, attribute ORDER BY tx) AS closes FROM g WHERE before IS NULL OR before <> state || coalesce(value, '~')), tl AS (SELECT entity, attribute, state, value, opens, closes, CAST(NULL AS VARCHAR) AS reason FROM o UNION ALL SELECT entity, attribute, 'refused', NULL, NULL, NULL, '{survivorship.TIE}' FROM b WHERE bad)"


@query(f"WITH {VO}, {_timeline('vo')} SELECT * FROM tl")
def timeline_valid_interval(spark, d):
    return survivorship.timeline(views.order_versions(spark, d))


@query(f"WITH {VE}, {_timeline('ve')} SELECT * FROM tl")
def timeline_events(spark, d):
    return survivorship.timeline(views.event_versions(spark, d))


def _about_interval(view: str, cte: str, valid: int, tx: int) -> str:
    return f"WITH {cte}, {_timeline(view, f'tx <= {tx}')} SELECT k.entity, k.attribute, coalesce(t.state, 'unknown') AS state, t.value, t.reason FROM (SELECT DISTINCT entity, attribute FROM {view}) k LEFT JOIN (SELECT * FROM tl WHERE state = 'refused' OR opens <= {valid} AND (closes IS NULL OR {valid} < closes)) t ON k.entity = t.entity AND k.attribute = t.attribute"


@query(_about_interval("vo", VO, MID, MID + 10**10))
def about_valid_interval(spark, d):
    return survivorship.about(views.order_versions(spark, d), Policy(Strategy.VALID_INTERVAL), MID, MID + 10**10)


def _about_recent(view: str, tx: int) -> str:
    return f"SELECT k.entity, k.attribute, coalesce(m.state, 'unknown') AS state, m.value, m.reason FROM (SELECT DISTINCT entity, attribute FROM {view}) k LEFT JOIN ({_recent(view, f'tx <= {tx}')}) m ON k.entity = m.entity AND k.attribute = m.attribute"


@query(f"WITH {VO} {_about_recent('vo', MID)}")
def about_most_recent(spark, d):
    return survivorship.about(views.order_versions(spark, d), Policy(Strategy.MOST_RECENT), MID, MID)


@query(f"WITH {VO}, {VE}, u AS ({_about_recent('vo', TX_T)}), w AS ({_about_interval('ve', VE, TX_T, TX_T)}) SELECT * FROM u UNION ALL SELECT * FROM w")
def policy_by_attribute(spark, d):
    both = views.order_versions(spark, d).unionByName(views.event_versions(spark, d))
    return survivorship.about(both, Policy(Strategy.MOST_RECENT, {"activity": Strategy.VALID_INTERVAL}), TX_T, TX_T)


@query(f"WITH {VO}, m AS ({_recent('vo')}), z AS (SELECT entity, min(tx) AS valid_from, max(tx) AS tx FROM vo GROUP BY 1), s AS (SELECT vo.entity, max(seq) AS seq FROM vo JOIN z ON vo.entity = z.entity AND vo.tx = z.tx GROUP BY 1) SELECT m.entity, m.attribute, m.state, m.value, z.valid_from, CAST(NULL AS BIGINT) AS valid_to, z.tx, s.seq FROM m JOIN z ON m.entity = z.entity JOIN s ON s.entity = m.entity WHERE m.state <> 'refused'")
def assert_resolved_rows(spark, d):
    return survivorship.assert_resolved(views.order_versions(spark, d), Strategy.MOST_RECENT)


@query(f"WITH {VE} SELECT entity, attribute, seq, tx, coalesce(max(CASE WHEN tx <= {TX_T} THEN tx END) OVER (PARTITION BY entity, attribute) > tx, false) AS superseded FROM ve")
def superseded_flags(spark, d):
    return survivorship.superseded(views.event_versions(spark, d), TX_T).select("entity", "attribute", "seq", "tx", "superseded")


# vectors


def _topk(score: str, k: int, cond: str = "true") -> str:
    return f"WITH v AS (SELECT vec_id, label, vec_id % 3 AS session, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT q.vec_id AS query_id, b.vec_id AS assertion_id, {score} AS score FROM v q JOIN v b ON {cond} WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, assertion_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, assertion_id, round(score, 6) AS score FROM r WHERE rank <= {k}"


COSINE = "list_dot_product(q.x, b.x) / sqrt(list_dot_product(q.x, q.x)) / sqrt(list_dot_product(b.x, b.x))"


def _search(spark, d, k: int, metric: str = "cosine", match: list[str] | None = None) -> DataFrame:
    v = vector.prepare(views.vectors(spark, d), 64, metric)
    asked = v.where(F.col("assertion_id") % 20 == 0).withColumnRenamed("assertion_id", "query_id")
    return vector.search(v, asked, k, metric, match).withColumn("score", F.round("score", 6))


@query(_topk(COSINE, 10))
def vector_topk_cosine(spark, d):
    return _search(spark, d, 10)


@query(_topk("-list_distance(q.x, b.x)", 10))
def vector_topk_l2(spark, d):
    return _search(spark, d, 10, "l2")


@query(_topk(COSINE, 5, "q.label = b.label"))
def vector_topk_filtered(spark, d):
    return _search(spark, d, 5, match=["entity"])


VV = "vv AS (SELECT CAST(label AS BIGINT) AS entity, 'topic' || (vec_id % 5) AS attribute, 'v' || vec_id AS value, vec_id * 1000 AS valid_from, CASE WHEN vec_id % 4 = 0 THEN vec_id * 1000 + 100000 END AS valid_to, vec_id * 1000 + vec_id % 7 * 5000 AS tx, CASE vec_id % 3 WHEN 0 THEN 'user_assertion' WHEN 1 THEN 'tool_output' ELSE 'agent_inference' END AS source, CAST(vec_id % 3 AS VARCHAR) AS session, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
SCOPE_T = (300_000, 350_000)


def _recall_sql(scope: str, horizon: str, same: str = "true") -> str:
    return f"WITH {VV}, s AS (SELECT q.vec_id AS query_id, b.*, {COSINE} AS score FROM vv q JOIN vv b ON {same} WHERE q.vec_id % 20 = 0 AND {scope}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), l AS (SELECT entity, attribute, max(tx) AS last FROM vv WHERE {horizon} GROUP BY 1, 2) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id AS assertion_id, round(score, 6) AS score, r.entity, r.attribute, value, r.tx, source, coalesce(last > r.tx, false) AS superseded FROM r LEFT JOIN l ON l.entity = r.entity AND l.attribute = r.attribute WHERE rank <= 5"


def _recalled(spark, d, query: Query, match: list[str] | None = None) -> DataFrame:
    v = views.vector_versions(spark, d)
    x = views.vectors(spark, d).select("assertion_id", "vector")
    asked = x.where("assertion_id % 20 = 0").withColumn("session", (F.col("assertion_id") % 3).cast("string")).withColumnRenamed("assertion_id", "query_id")
    out = recall(v, vector.prepare(x, 64), asked, query, 64, match=match)
    return out.select("query_id", "rank", "assertion_id", F.round("score", 6).alias("score"), "entity", "attribute", "value", "tx", "source", "superseded")


AS_OF = f"b.tx <= {SCOPE_T[1]} AND b.valid_from <= {SCOPE_T[0]} AND (b.valid_to IS NULL OR {SCOPE_T[0]} < b.valid_to)"


@query(_recall_sql(AS_OF, f"tx <= {SCOPE_T[1]}", "q.session = b.session"))
def recall_as_of_scope(spark, d):
    return _recalled(spark, d, Query(5).as_of(*SCOPE_T), ["session"])


@query(_recall_sql("b.source = 'tool_output' AND b.entity = 1", "true"))
def recall_entity_source(spark, d):
    return _recalled(spark, d, Query(5).about_entity(1).from_source("tool_output"))


@query(_recall_sql("b.session = '2'", "true"))
def recall_session(spark, d):
    return _recalled(spark, d, Query(5).in_session("2"))


BADS = "w AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_slice(embedding, 1, 63) WHEN vec_id % 11 = 0 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT)) WHEN vec_id % 13 = 0 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 5 THEN CAST('nan' AS FLOAT) ELSE x END) ELSE embedding END AS x, vec_id % 7 = 0 AS a, vec_id % 11 = 0 AS b, vec_id % 13 = 0 AS c FROM embeddings)"


def _spoilt(spark, d) -> DataFrame:
    """The vectors, some of them of a wrong length, zero or not finite."""
    v, i = views.vectors(spark, d), F.col("assertion_id")
    spoilt = F.when(i % 7 == 0, F.slice("vector", 1, 63)).when(i % 11 == 0, F.transform("vector", lambda x: F.lit(0.0).cast("float"))).when(i % 13 == 0, F.transform("vector", lambda x, n: F.when(n == 4, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(F.col("vector"))
    return v.withColumn("vector", spoilt)


@query(f"WITH {BADS} SELECT vec_id AS assertion_id, CASE WHEN a THEN 'wrong dimension' WHEN b THEN 'zero vector' WHEN c THEN 'not finite at 4' END AS why FROM w")
def vector_check(spark, d):
    return _spoilt(spark, d).select("assertion_id", vector.problems("vector", 64).alias("why"))


@query(f"WITH {BADS} SELECT vec_id AS assertion_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS norm FROM embeddings WHERE vec_id IN (SELECT vec_id FROM w WHERE NOT a AND NOT b AND NOT c)")
def vector_prepare(spark, d):
    return vector.prepare(_spoilt(spark, d), 64).select("assertion_id", F.round(vector.norm("vector"), 6).alias("norm"))


@query("SELECT vec_id AS assertion_id, CASE WHEN vec_id % 10 = 3 THEN 'new' ELSE 'old' END AS origin FROM embeddings WHERE vec_id % 4 <> 1 UNION ALL SELECT vec_id + 1000000, 'new' FROM embeddings WHERE vec_id % 10 = 3")
def vector_upsert_remove(spark, d):
    """Every tenth vector is put in again and once more under a new id; then every fourth goes, but for the new ids."""
    v = views.vectors(spark, d).select("assertion_id", "vector").withColumn("origin", F.lit("old"))
    some = v.where("assertion_id % 10 = 3").withColumn("origin", F.lit("new"))
    index = vector.upsert(vector.upsert(v, some), some.withColumn("assertion_id", F.col("assertion_id") + 1_000_000))
    return vector.remove(index, v.where("assertion_id % 4 = 1")).select("assertion_id", "origin")


@query("SELECT CAST(count(*) AS BIGINT) AS len, 64 AS dim, 'cosine' AS metric, count(*) FILTER (WHERE vec_id = 7) > 0 AS has_7, false AS has_none FROM embeddings")
def vector_index_shape(spark, d):
    i = vector.Index.open(vector.prepare(views.vectors(spark, d).select("assertion_id", "vector"), 64), 64)
    return spark.createDataFrame([(len(i), i.dim, i.metric, 7 in i, -1 in i)], "len long, dim int, metric string, has_7 boolean, has_none boolean")


# walks


def _khop(seeds: str, hops: int, steps: str, via: str = "true") -> str:
    return f"WITH RECURSIVE {EDGES}, {FORCE.format(valid=LAST_EDGE, tx=LAST_EDGE)}, st AS (SELECT a, b FROM ({steps}) WHERE {via}), w AS (SELECT CAST(entity AS BIGINT) AS entity, 0 AS distance FROM ({seeds}) UNION SELECT CAST(st.b AS BIGINT), w.distance + 1 FROM w JOIN st ON st.a = w.entity WHERE w.distance < {hops}), m AS (SELECT entity, min(distance) AS distance FROM w GROUP BY 1)"


OUT, BACK = "SELECT subject AS a, object AS b, predicate FROM f", "SELECT object AS a, subject AS b, predicate FROM f"
ALL_OF = "SELECT entity, CAST(distance AS INTEGER) AS distance, false AS truncated FROM m"


def _walk(spark, d, seeds: DataFrame, **options) -> DataFrame:
    e = views.edge_versions(spark, d)
    return graph.neighborhood(e, None, seeds, graph.Walk(LAST_EDGE, LAST_EDGE, **options))


def _ids(spark, d, name: str, key: str, kind: str) -> DataFrame:
    return views.table(spark, d, name).select((F.col(key).cast("long") + views.OFFSETS[kind]).alias("entity"))


SUPPLIERS, REGIONS = "SELECT s_suppkey + 100000 AS entity FROM supplier", "SELECT r_regionkey AS entity FROM region"


@query(_khop(SUPPLIERS, 3, OUT) + ALL_OF)
def khop_out(spark, d):
    return _walk(spark, d, _ids(spark, d, "supplier", "s_suppkey", "supplier"), hops=3)


@query(_khop(REGIONS, 2, BACK) + ALL_OF)
def khop_in(spark, d):
    return _walk(spark, d, _ids(spark, d, "region", "r_regionkey", "region"), hops=2, direction="in")


@query(_khop(SUPPLIERS, 1, f"{OUT} UNION ALL {BACK}") + ALL_OF)
def khop_both(spark, d):
    return _walk(spark, d, _ids(spark, d, "supplier", "s_suppkey", "supplier"), hops=1, direction="both")


@query(_khop(SUPPLIERS, 2, OUT, "predicate = 'in_nation'") + ALL_OF)
def khop_predicate(spark, d):
    return _walk(spark, d, _ids(spark, d, "supplier", "s_suppkey", "supplier"), hops=2, via=("in_nation",))


@query(_khop(REGIONS, 2, BACK) + "SELECT entity, CAST(distance AS INTEGER) AS distance, (SELECT count(*) FROM m) > 100 AS truncated FROM m ORDER BY distance, entity LIMIT 100")
def khop_budget_truncated(spark, d):
    return _walk(spark, d, _ids(spark, d, "region", "r_regionkey", "region"), hops=2, direction="in", budget=100)


# entity resolution

NORM = "lower(trim(regexp_replace(regexp_replace({0}, '[^a-zA-Z0-9 ]', '', 'g'), ' +', ' ', 'g')))"
BRAND = resolve.Blocking("exact", "brand")
PREFIX = resolve.Blocking("prefix", "name", 3)
TOKEN = resolve.Blocking("token", "name")
MARK = resolve.Blocking("exact", "mark")
#: Rules under which records of all parts match, are reviewed and fail.
MARKED = resolve.Ruleset((resolve.Rule("name", "token_jaccard", 0.9, 0.05), resolve.Rule("type", "exact", 0.9, 0.2)), (MARK,), 0.0, 2.0)
RULES = resolve.Ruleset((resolve.Rule("name", "token_jaccard", 0.9, 0.05),), (TOKEN,), -0.9, 3.0)


def _sizes(key: str) -> str:
    return f"SELECT key, count(*) AS records, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS pairs FROM (SELECT DISTINCT p_partkey, {key} AS key FROM part) GROUP BY 1"


@query(_sizes(f"'brand=' || {NORM.format('p_brand')}"))
def blocking_exact(spark, d):
    return resolve.block_sizes(views.part_records(spark, d), (BRAND,))


@query(_sizes(f"'name~' || left({NORM.format('p_name')}, 3)"))
def blocking_prefix(spark, d):
    return resolve.block_sizes(views.part_records(spark, d), (PREFIX,))


@query(_sizes(f"'name#' || unnest(string_split({NORM.format('p_name')}, ' '))"))
def blocking_token(spark, d):
    return resolve.block_sizes(views.part_records(spark, d), (TOKEN,))


NAMES = "n AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name)"
PAIRS = f"{NAMES}, t AS (SELECT id, name, string_split({NORM.format('name')}, ' ') AS w FROM n), p AS (SELECT x.id AS a, y.id AS b, len(list_filter(x.w, lambda z: list_contains(y.w, z))) AS shared, len(x.w) + len(y.w) AS total FROM t x JOIN t y ON x.id < y.id AND len(list_intersect(x.w, y.w)) > 0), j AS (SELECT a, b, shared / CAST(total - shared AS DOUBLE) AS sim FROM p), s AS (SELECT a, b, sim, sim * log2(0.9 / 0.05) + (1 - sim) * log2((1 - 0.9) / (1 - 0.05)) AS score FROM j)"
BAND = "CASE WHEN score >= 3.0 THEN 'match' WHEN score >= -0.9 THEN 'review' ELSE 'non_match' END"


@query(f"SELECT p_partkey AS id, {NORM.format('p_name')} AS name, {NORM.format('p_brand')} AS brand FROM part")
def normalize_text(spark, d):
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.normalize(F.col("p_name")).alias("name"), T.normalize(F.col("p_brand")).alias("brand"))


@query(f"WITH {PAIRS} SELECT a, b FROM j")
def candidate_pairs(spark, d):
    return resolve.candidate_pairs(views.name_records(spark, d), (TOKEN,))


def _named_pairs(spark, d, f) -> DataFrame:
    n = views.name_records(spark, d)
    p = resolve.candidate_pairs(n, (TOKEN,))
    both = p.join(n.select(F.col("id").alias("a"), F.col("record")["name"].alias("na")), "a").join(n.select(F.col("id").alias("b"), F.col("record")["name"].alias("nb")), "b")
    return both.select("a", "b", F.round(f(F.col("na"), F.col("nb")), 6).alias("similarity"))


@query(f"WITH {PAIRS} SELECT a, b, round(sim, 6) AS similarity FROM j")
def token_jaccard_pairs(spark, d):
    return _named_pairs(spark, d, T.token_jaccard)


@query()
def jaro_winkler_pairs(spark, d):
    return _named_pairs(spark, d, T.jaro_winkler)


@query()
def possessive_pairs(spark, d):
    return _named_pairs(spark, d, T.possessive_aware)


@query(f"WITH {PAIRS} SELECT a, b, round(score, 6) AS score FROM s")
def score_pairs(spark, d):
    return resolve.scored_pairs(views.name_records(spark, d), RULES).select("a", "b", F.round("score", 6).alias("score"))


@query(f"WITH {PAIRS} SELECT {BAND} AS decision, count(*) AS pairs FROM s GROUP BY 1")
def decide_bands(spark, d):
    return resolve.scored_pairs(views.name_records(spark, d), RULES).groupBy("decision").agg(F.count("*").alias("pairs"))


CLUSTERS = f"WITH RECURSIVE {PAIRS}, g AS (SELECT a, b FROM s WHERE {BAND} = 'match' UNION ALL SELECT b, a FROM s WHERE {BAND} = 'match'), c AS (SELECT id, id AS other FROM n UNION SELECT c.id, g.b FROM c JOIN g ON g.a = c.other), l AS (SELECT id, min(other) AS cluster FROM c GROUP BY 1)"


@query(CLUSTERS + " SELECT id, cluster FROM l")
def resolve_clusters(spark, d):
    return resolve.resolve(views.name_records(spark, d), RULES)[0]


@query(CLUSTERS + " SELECT p.p_partkey AS id, l.cluster FROM part p JOIN n ON n.name = p.p_name JOIN l ON l.id = n.id")
def resolve_members(spark, d):
    return resolve.resolve_copies(views.part_names(spark, d), RULES)


@query(f"WITH {PAIRS}, k AS (SELECT min(p_partkey) AS id, count(*) AS c FROM part GROUP BY p_name), w AS (SELECT {BAND} AS decision, x.c * y.c AS pairs FROM s JOIN k x ON x.id = s.a JOIN k y ON y.id = s.b UNION ALL SELECT 'match', c * (c - 1) // 2 FROM k WHERE c > 1) SELECT decision, CAST(sum(pairs) AS BIGINT) AS pairs FROM w GROUP BY 1")
def decide_bands_weighted(spark, d):
    return resolve.weighted_bands(views.part_names(spark, d), RULES)


@query(CLUSTERS + f" SELECT s.a, s.b, round(s.score, 6) AS score FROM s JOIN l x ON x.id = s.a JOIN l y ON y.id = s.b WHERE {BAND} = 'review' AND x.cluster <> y.cluster")
def resolve_review_band(spark, d):
    return resolve.resolve(views.name_records(spark, d), RULES)[1].withColumn("score", F.round("score", 6))


MARKS = f"n AS (SELECT p_partkey AS id, string_split({NORM.format('p_name')}, ' ') AS w, p_type AS type, p_brand || ' ' || p_size AS mark FROM part), p AS (SELECT x.id AS a, y.id AS b, len(list_filter(x.w, lambda z: list_contains(y.w, z))) AS shared, len(x.w) + len(y.w) AS total, x.type = y.type AS same FROM n x JOIN n y ON x.mark = y.mark AND x.id < y.id), j AS (SELECT a, b, shared / CAST(total - shared AS DOUBLE) AS sim, same FROM p), s AS (SELECT a, b, sim * log2(0.9 / 0.05) + (1 - sim) * log2((1 - 0.9) / (1 - 0.05)) + CASE WHEN same THEN log2(0.9 / 0.2) ELSE log2((1 - 0.9) / (1 - 0.2)) END AS score FROM j)"
MBAND = "CASE WHEN score >= 2.0 THEN 'match' WHEN score >= 0.0 THEN 'review' ELSE 'non_match' END"
MCLUSTERS = f"WITH RECURSIVE {MARKS}, g AS (SELECT a, b FROM s WHERE {MBAND} = 'match' UNION ALL SELECT b, a FROM s WHERE {MBAND} = 'match'), c AS (SELECT id, id AS other FROM n UNION SELECT c.id, g.b FROM c JOIN g ON g.a = c.other), l AS (SELECT id, min(other) AS cluster FROM c GROUP BY 1)"


@query(f"WITH {MARKS} SELECT a, b, round(score, 6) AS score, {MBAND} AS decision FROM s")
def score_parts(spark, d):
    return resolve.scored_pairs(views.part_marks(spark, d), MARKED, 6)


@query(f"WITH {MARKS} SELECT {MBAND} AS decision, count(*) AS pairs FROM s GROUP BY 1")
def decide_parts(spark, d):
    return resolve.weighted_bands(views.part_marks(spark, d), MARKED)


@query(MCLUSTERS + " SELECT id, cluster FROM l")
def resolve_parts(spark, d):
    return resolve.resolve(views.part_marks(spark, d), MARKED)[0]


@query(MCLUSTERS + f" SELECT s.a, s.b, round(s.score, 6) AS score FROM s JOIN l x ON x.id = s.a JOIN l y ON y.id = s.b WHERE {MBAND} = 'review' AND x.cluster <> y.cluster")
def review_parts(spark, d):
    return resolve.resolve(views.part_marks(spark, d), MARKED)[1].withColumn("score", F.round("score", 6))


@query(MCLUSTERS + ", f AS (SELECT s.a, s.b FROM s JOIN l x ON x.id = s.a JOIN l y ON y.id = s.b WHERE " + MBAND + " = 'review' AND x.cluster <> y.cluster) SELECT a, b FROM f WHERE (a + b) % 2 = 0")
def reject_parts(spark, d):
    """The rejected pairs after every second review is settled as different."""
    review = resolve.resolve(views.part_marks(spark, d), MARKED)[1].withColumn("review", F.xxhash64("a", "b"))
    return mutations.reject(review, spark.createDataFrame([], "a long, b long"), review.where("(a + b) % 2 = 0"))[1]


@query("WITH p AS (SELECT p_partkey AS mention, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS first FROM part) SELECT mention, dense_rank() OVER (ORDER BY first) AS entity, CASE WHEN mention = first THEN 'created' ELSE 'merged' END AS outcome FROM p")
def remember_exact(spark, d):
    """Mentions that agree in name and brand are one entity, numbered by its first mention."""
    rules = resolve.Ruleset((resolve.Rule("name", "exact", 0.9, 0.05), resolve.Rule("brand", "exact", 0.9, 0.1)), (PREFIX, BRAND), 6.0, 6.0)
    rules = resolve.Ruleset(rules.rules, (resolve.Blocking("exact", "key"),), 6.0, 6.0)
    parts = views.part_records(spark, d).select("id", F.map_concat("record", F.create_map(F.lit("key"), F.concat_ws(" ", F.col("record")["name"], F.col("record")["brand"]))).alias("record"))
    return remember.remember(parts, rules)[0]


@query("WITH p AS (SELECT p_partkey AS mention, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS first FROM part) SELECT mention, dense_rank() OVER (ORDER BY first) AS entity, CASE WHEN mention = first THEN 'created' ELSE 'merged' END AS outcome FROM p")
def remember_two_batches(spark, d):
    """remember_exact in two batches: the second meets the entities that the first left."""
    rules = resolve.Ruleset((resolve.Rule("name", "exact", 0.9, 0.05), resolve.Rule("brand", "exact", 0.9, 0.1)), (resolve.Blocking("exact", "key"),), 6.0, 6.0)
    parts = views.part_records(spark, d).select("id", F.map_concat("record", F.create_map(F.lit("key"), F.concat_ws(" ", F.col("record")["name"], F.col("record")["brand"]))).alias("record"))
    half = parts.agg(F.expr("max(id) div 2")).first()[0]
    one = remember.remember_into(parts.where(F.col("id") <= half), rules)
    two = remember.remember_into(parts.where(F.col("id") > half), rules, one.identity)
    return one.told.unionByName(two.told)


@query("SELECT p_partkey AS id, 1 AS form, p_name AS owner, p_type AS head FROM part UNION ALL SELECT p_partkey, 2, 'Their', p_name FROM part UNION ALL SELECT p_partkey, 3, NULL, p_name FROM part UNION ALL SELECT p_partkey, 4, p_name || 's', p_type FROM part UNION ALL SELECT p_partkey, 5, NULL, 'O' || chr(39) || p_name FROM part")
def possessive_parts(spark, d):
    """Owners and heads of phrases made of names, in five forms."""
    n, t = F.col("p_name"), F.col("p_type")
    forms = [F.concat(n, F.lit("'s "), t), F.concat(F.lit("  Their\t"), n), n, F.concat(n, F.lit("s\u2019  "), t), F.concat(F.lit("O'"), n)]
    p = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(F.array(*forms)).alias("form", "phrase"))
    return p.select("id", (F.col("form") + 1).alias("form"), T.possessive_parts(F.col("phrase")).alias("x")).select("id", "form", "x.owner", "x.head")


@query()
def remember_incremental(spark, d):
    return remember.remember(views.part_names(spark, d), RULES)[0]


@query()
def remember_reviews(spark, d):
    return remember.remember(views.part_names(spark, d), RULES)[1]


# writes

MERGED = "mg AS (SELECT c_custkey + 10000000 AS absorbed, c_custkey + 9999999 AS kept FROM customer WHERE c_custkey % 2 = 0)"


def _merged(spark, d) -> DataFrame:
    """Every customer with an even key goes into the one before."""
    c = views.table(spark, d, "customer").where("c_custkey % 2 = 0")
    return c.select((F.col("c_custkey") + 10_000_000).alias("absorbed"), (F.col("c_custkey") + 9_999_999).alias("kept"))


@query(f"WITH {EDGES}, {MERGED}, m AS (SELECT coalesce(x.kept, subject) AS subject, predicate, coalesce(y.kept, object) AS object, seq, tx, present, CASE WHEN x.kept IS NULL AND y.kept IS NULL THEN 0 ELSE 1 END AS origin, subject AS s0, object AS o0 FROM e LEFT JOIN mg x ON x.absorbed = e.subject LEFT JOIN mg y ON y.absorbed = e.object), z AS (SELECT *, count(DISTINCT CAST(s0 AS VARCHAR) || '/' || CAST(o0 AS VARCHAR)) OVER (PARTITION BY subject, predicate, object) AS many FROM m WHERE subject <> object) SELECT subject, predicate, object, CAST(CASE WHEN many > 1 THEN row_number() OVER (PARTITION BY subject, predicate, object ORDER BY tx, origin, s0, o0, seq) - 1 ELSE seq END AS BIGINT) AS seq, present, tx FROM z")
def repoint_logs(spark, d):
    """Whole logs after the merges, in their order."""
    return mutations.repoint_edges(views.edge_versions(spark, d), _merged(spark, d)).select("subject", "predicate", "object", "seq", "present", "tx")


@query(f"WITH {EDGES}, {MERGED}, t AS (SELECT DISTINCT subject, predicate, object FROM e), m AS (SELECT mg.kept, t.* FROM t JOIN mg ON mg.absorbed = t.subject UNION SELECT mg.kept, t.* FROM t JOIN mg ON mg.absorbed = t.object) SELECT kept, count(*) AS moved FROM m GROUP BY 1")
def repoint_counts(spark, d):
    return mutations.repointed(views.edge_versions(spark, d), _merged(spark, d))


@query(f"WITH {EDGES}, {MERGED} SELECT DISTINCT coalesce(x.kept, subject) AS subject, predicate, coalesce(y.kept, object) AS object FROM e LEFT JOIN mg x ON x.absorbed = e.subject LEFT JOIN mg y ON y.absorbed = e.object WHERE coalesce(x.kept, subject) <> coalesce(y.kept, object)")
def repoint_edges(spark, d):
    return mutations.repoint_edges(views.edge_versions(spark, d), _merged(spark, d)).select("subject", "predicate", "object").distinct()


@query(f"WITH {VO}, gone AS (SELECT DISTINCT entity FROM vo WHERE state = 'absent') SELECT entity, attribute, seq, state, value, tx FROM vo WHERE entity NOT IN (SELECT entity FROM gone)")
def erase_attribute(spark, d):
    v = views.order_versions(spark, d)
    return mutations.erase_attribute(v, v.where("state = 'absent'"))[0].select("entity", "attribute", "seq", "state", "value", "tx")


@query(f"WITH {VO}, gone AS (SELECT DISTINCT entity FROM vo WHERE state = 'absent') SELECT entity, attribute, count(*) AS erased FROM vo WHERE entity IN (SELECT entity FROM gone) GROUP BY 1, 2")
def erase_attribute_counts(spark, d):
    v = views.order_versions(spark, d)
    return mutations.erase_attribute(v, v.where("state = 'absent'"))[1]


@query(f"WITH {VO}, gone AS (SELECT DISTINCT entity FROM vo WHERE state = 'absent'), m AS (SELECT entity, max(seq) AS s FROM vo GROUP BY 1) SELECT entity, attribute, seq, state, value, tx FROM vo UNION ALL SELECT g.entity, 'order_status', m.s + 1, 'absent', NULL, {LAST_EDGE} FROM gone g JOIN m ON g.entity = m.entity")
def forget_attribute(spark, d):
    v = views.order_versions(spark, d)
    return mutations.forget_attribute(v, v.select("entity", "attribute", "seq"), v.where("state = 'absent'"), LAST_EDGE, "user_assertion", "s")[0].select("entity", "attribute", "seq", "state", "value", "tx")


@query(f"WITH {EDGES}, gone AS (SELECT s_suppkey + 100000 AS id FROM supplier WHERE s_acctbal < 0) SELECT subject, predicate, object, CAST(seq AS BIGINT) AS seq, present FROM e WHERE subject NOT IN (SELECT id FROM gone) AND object NOT IN (SELECT id FROM gone)")
def erase_edges(spark, d):
    gone = views.table(spark, d, "supplier").where("s_acctbal < 0").select((F.col("s_suppkey") + 100_000).alias("entity"))
    return mutations.erase_edges(views.edge_versions(spark, d), gone)[0].select("subject", "predicate", "object", "seq", "present")


CHAIN = "SELECT c_custkey AS absorbed, c_custkey - c_custkey % 3 AS kept FROM customer WHERE c_custkey % 3 > 0"


def _memory(spark, d) -> Memory:
    """Customers as entities with their order logs, names as identity, and reviews that chain three by three."""
    c = views.table(spark, d, "customer")
    m = Memory.empty(spark)
    entities = c.select(F.col("c_custkey").alias("entity"), F.lit("customer").alias("kind"), F.lit(0).cast("long").alias("created_at"))
    identity = c.select(F.col("c_custkey").alias("entity"), F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("name"), F.col("c_name"))).otherwise(F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))).alias("record"))
    reviews = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("review"), (F.col("c_custkey") - 1).alias("a"), F.col("c_custkey").alias("b"), F.lit(1.0).alias("score"))
    reviews = reviews.unionByName(c.where("c_custkey % 6 = 0 and c_custkey > 2").select((F.col("c_custkey") + 10_000_000).alias("review"), (F.col("c_custkey") - 2).alias("a"), (F.col("c_custkey") + 1).alias("b"), F.lit(2.0).alias("score")))
    rejected = c.where("c_custkey % 6 = 1 and c_custkey > 2").select((F.col("c_custkey") - 2).alias("a"), F.col("c_custkey").alias("b"))
    versions = mutations.filled(views.order_versions(spark, d), m.versions).select(*m.versions.columns)
    return Memory(entities, versions, m.edges, identity, m.vectors, reviews, rejected)


def _confirmed(spark, d) -> Memory:
    m = _memory(spark, d)
    return m.confirm(m.reviews.where("review < 10000000").select("review"))


@query(f"WITH {VO}, mg AS ({CHAIN}) SELECT coalesce(kept, entity) AS entity, attribute, row_number() OVER (PARTITION BY coalesce(kept, entity), attribute ORDER BY entity, seq) - 1 AS seq, state, value, tx FROM vo LEFT JOIN mg ON absorbed = entity")
def confirm_merge(spark, d):
    """Logs after chains of merges: the survivor's own versions come first."""
    return _confirmed(spark, d).versions.select("entity", "attribute", "seq", "state", "value", "tx")


@query("SELECT c_custkey AS entity, c_name AS name, (SELECT s.c_mktsegment FROM customer s WHERE s.c_custkey BETWEEN c.c_custkey + 1 AND c.c_custkey + 2 ORDER BY s.c_custkey LIMIT 1) AS segment FROM customer c WHERE c_custkey % 3 = 0")
def confirm_identity(spark, d):
    """Identity after chains of merges: fields as first spelt, new ones from the absorbed."""
    return _confirmed(spark, d).identity.select("entity", F.col("record")["name"].alias("name"), F.col("record")["segment"].alias("segment"))


@query("SELECT DISTINCT CAST(a - a % 3 AS BIGINT) AS a, CAST(b - b % 3 AS BIGINT) AS b, 'review' AS what FROM (SELECT c_custkey - 2 AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 6 = 0 AND c_custkey > 2) WHERE b <= (SELECT max(c_custkey) + 1 FROM customer) UNION ALL SELECT DISTINCT CAST(c_custkey - 2 - (c_custkey - 2) % 3 AS BIGINT), CAST(c_custkey - c_custkey % 3 AS BIGINT), 'rejected' FROM customer WHERE c_custkey % 6 = 1 AND c_custkey > 2")
def confirm_pairs(spark, d):
    """Open reviews and rejected pairs after chains of merges name the survivors."""
    m = _confirmed(spark, d)
    return m.reviews.select("a", "b", F.lit("review").alias("what")).unionByName(m.rejected.select("a", "b", F.lit("rejected").alias("what")))


@query("SELECT CAST(count(*) AS BIGINT) AS entities, CAST(min(c_custkey) AS BIGINT) AS first, CAST(max(c_custkey) AS BIGINT) AS last FROM customer WHERE c_custkey % 3 = 0")
def entity_count(spark, d):
    """What resolution knows after the merges: absorbed entities are none."""
    return _confirmed(spark, d).entity_ids().agg(F.count("*").alias("entities"), F.min("entity").alias("first"), F.max("entity").alias("last"))


@query("SELECT c_custkey AS entity, c_name AS name FROM customer WHERE c_custkey = 42")
def identity_of(spark, d):
    return _memory(spark, d).identity_of(42).select("entity", F.col("record")["name"].alias("name"))


@query("SELECT c_custkey AS entity, 'customer' AS kind FROM customer WHERE c_custkey = 7")
def entity_lookup(spark, d):
    return temporal.entity(_memory(spark, d).entities, 7).select("entity", "kind")


@query("SELECT c_custkey AS review, c_custkey - 1 AS a, x.c_name AS a_name, c.c_custkey AS b, c.c_name AS b_name FROM customer c JOIN (SELECT c_custkey AS k, c_name FROM customer) x ON x.k = c.c_custkey - 1 WHERE c_custkey % 3 > 0")
def pending_review(spark, d):
    m = _memory(spark, d)
    return m.named_reviews().where("review < 10000000").select("review", "a", "a_name", "b", "b_name")


WRITTEN = "SELECT CAST(label AS BIGINT) AS entity, 'topic' || (vec_id % 5) AS attribute, vec_id, row_number() OVER (ORDER BY vec_id) AS assertion_id FROM embeddings"


def _written(spark, d) -> Memory:
    """The vectors written as assertions, in the order of their ids."""
    v = views.vector_versions(spark, d).drop("seq", "assertion_id")
    x = views.table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("value"), F.col("vec_id").alias("at"), F.transform("embedding", lambda c: c.cast("double")).alias("vector"))
    m = Memory.empty(spark)
    entities = v.select("entity").distinct().select("entity", F.lit("topic").alias("kind"), F.lit(0).cast("long").alias("created_at"))
    return Memory(entities, m.versions, m.edges, m.identity, m.vectors, m.reviews, m.rejected).write(v.join(x, "value"), ["at"])


@query(f"WITH w AS ({WRITTEN}) SELECT entity, attribute, row_number() OVER (PARTITION BY entity, attribute ORDER BY tx, assertion_id) - 1 AS seq, assertion_id, 'v' || w.vec_id AS value, true AS has_vector FROM w JOIN (SELECT vec_id, vec_id * 1000 + vec_id % 7 * 5000 AS tx FROM embeddings) t USING (vec_id)")
def write_assertions(spark, d):
    """Version, vector and assertion of each write stand together."""
    m = _written(spark, d)
    return m.versions.join(m.vectors.select("assertion_id", F.lit(True).alias("has_vector")), "assertion_id", "left").select("entity", "attribute", "seq", "assertion_id", "value", "has_vector")


@query(f"WITH w AS ({WRITTEN}) SELECT assertion_id FROM w WHERE NOT (entity = 1 AND attribute = 'topic2')")
def erase_with_vectors(spark, d):
    """The vectors left after an attribute of an entity is erased."""
    m = _written(spark, d)
    return m.erase(spark.createDataFrame([(1, "topic2")], "entity long, attribute string"))[0].vectors.select("assertion_id")


@query("WITH m AS (SELECT max(c_custkey) AS top FROM customer) SELECT s_suppkey, top + 1 + row_number() OVER (ORDER BY s_suppkey) - 1 AS entity FROM supplier, m")
def create_entities(spark, d):
    known = views.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    return mutations.create_entities(known, views.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")


AT = 884217600000


@query(f"WITH {EDGES}, r AS (SELECT r_regionkey AS object, n_nationkey + 1000 AS subject FROM region, nation) SELECT subject, predicate, object, CAST(seq AS BIGINT) AS seq, present FROM e WHERE predicate = 'in_region' UNION ALL SELECT r.subject, 'in_region', CAST(r.object AS BIGINT), CASE WHEN n.n_nationkey IS NULL THEN 0 ELSE 1 END, true FROM r LEFT JOIN nation n ON n.n_nationkey + 1000 = r.subject AND n.n_regionkey = r.object")
def relate_edges(spark, d):
    """Every nation is put in every region: a second version where it is one already."""
    e = views.edge_versions(spark, d).where("predicate = 'in_region'")
    s, o = e.select("subject").distinct(), _ids(spark, d, "region", "r_regionkey", "region").withColumnRenamed("entity", "object")
    new = s.join(o).select("subject", F.lit("in_region").alias("predicate"), "object", F.lit(AT).alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.lit(AT).alias("tx"))
    ends = s.select(F.col("subject").alias("entity")).unionAll(o.select("object"))
    return mutations.relate(e, new, ends).select("subject", "predicate", "object", "seq", "present")


@query("SELECT CAST(n_nationkey + 1000 AS BIGINT) AS subject, 'in_region' AS predicate, CAST(n_regionkey AS BIGINT) AS object FROM nation WHERE n_nationkey % 2 = 1")
def unrelate_edges(spark, d):
    """In force after every second nation is taken out of its region."""
    e = views.edge_versions(spark, d).where("predicate = 'in_region'")
    return temporal.in_force(mutations.unrelate(e, e.where("subject % 2 = 0"), AT), AT, AT)


@query(f"WITH {EDGES}, gone AS (SELECT s_suppkey + 100000 AS id FROM supplier WHERE s_acctbal < 0), t AS (SELECT DISTINCT subject, predicate, object FROM e), x AS (SELECT subject AS entity, t.* FROM t UNION SELECT object, t.* FROM t) SELECT entity, count(*) AS erased FROM x WHERE entity IN (SELECT id FROM gone) GROUP BY 1")
def erase_edges_counts(spark, d):
    gone = views.table(spark, d, "supplier").where("s_acctbal < 0").select((F.col("s_suppkey") + 100_000).alias("entity"))
    return mutations.erase_edges(views.edge_versions(spark, d), gone)[1]


@query(f"WITH {EDGES}, c AS (SELECT subject, predicate, max(valid_from) AS ends FROM e WHERE predicate = 'supplied_by' GROUP BY 1, 2), v AS (SELECT e.*, c.ends, row_number() OVER (PARTITION BY e.subject, e.predicate, e.object ORDER BY e.tx DESC, e.seq DESC) AS r FROM e JOIN c ON c.subject = e.subject AND c.predicate = e.predicate WHERE valid_from <= ends) SELECT subject, predicate, object, ends AS valid_from FROM v WHERE r = 1 AND present")
def close_edges(spark, d):
    """What ends when each part's supplies are closed at its last change."""
    e = views.edge_versions(spark, d).where("predicate = 'supplied_by'")
    closures = e.groupBy("subject", "predicate").agg(F.max("valid_from").alias("at"))
    return mutations.close_edges(e, closures, e.where("false"))


@query(CLUSTERS + f" SELECT s.a, s.b FROM s JOIN l x ON x.id = s.a JOIN l y ON y.id = s.b WHERE {BAND} = 'review' AND x.cluster <> y.cluster")
def reject_pair(spark, d):
    review = resolve.resolve(views.name_records(spark, d), RULES)[1].withColumn("review", F.xxhash64("a", "b"))
    return mutations.reject(review, spark.createDataFrame([], "a long, b long"), review)[1]


# more of survivorship


def _survivor_sql(refused: str = "m.state <> 'refused'") -> str:
    return f"WITH {VO}, m AS ({_recent('vo')}) SELECT entity, attribute, value FROM m WHERE {refused}"


@query(_survivor_sql())
def survivor_value(spark, d):
    return survivorship.survivor(views.order_versions(spark, d), Strategy.MOST_RECENT)


@query(f"WITH {VO}, {_timeline('vo')} SELECT entity, attribute, CASE WHEN count(*) = 1 THEN min(value) END AS value FROM tl GROUP BY 1, 2 HAVING max(state = 'refused') = false")
def survivor_of_timeline(spark, d):
    """A timeline has a survivor only if it is a single fact."""
    return survivorship.survivor(views.order_versions(spark, d), Strategy.VALID_INTERVAL)


@query(f"WITH {VO}, {_timeline('vo')}, k AS (SELECT DISTINCT entity, attribute FROM vo) SELECT k.entity, k.attribute, t.value FROM k LEFT JOIN (SELECT * FROM tl WHERE opens <= {MID} AND (closes IS NULL OR {MID} < closes)) t ON t.entity = k.entity WHERE k.entity NOT IN (SELECT entity FROM tl WHERE state = 'refused')")
def outcome_as_of(spark, d):
    return survivorship.outcome_as_of(views.order_versions(spark, d), Strategy.VALID_INTERVAL, MID)


@query(f"WITH {VO}, {_timeline('vo')}, l AS (SELECT entity, max(tx) AS tx FROM vo GROUP BY 1), s AS (SELECT vo.entity, max(seq) AS seq FROM vo JOIN l ON l.entity = vo.entity AND l.tx = vo.tx GROUP BY 1) SELECT tl.entity, tl.attribute, tl.state, tl.value, opens AS valid_from, closes AS valid_to, l.tx, s.seq FROM tl JOIN l ON l.entity = tl.entity JOIN s ON s.entity = tl.entity WHERE tl.state <> 'refused'")
def assert_resolved_timeline(spark, d):
    return survivorship.assert_resolved(views.order_versions(spark, d), Strategy.VALID_INTERVAL)


@query("SELECT * FROM (VALUES ('most_complete', false), ('longest_value', false), ('majority_vote', false), ('confidence_majority', false), ('first_non_null', false), ('unanimous_or_null', false), ('most_recent', true), ('source_priority', true), ('valid_interval', true)) t(strategy, needs_provenance)")
def strategy_needs(spark, d):
    return spark.createDataFrame([(s.value, s.needs_provenance) for s in Strategy], "strategy string, needs_provenance boolean")


@query(_as_of_sql("ve", VE, VALID_T, TX_T).replace("SELECT k.entity, k.attribute, coalesce(top.state, 'unknown') AS state, top.value FROM", "SELECT k.entity, k.attribute, top.state IS NOT NULL AS known, top.value FROM"))
def known_values(spark, d):
    a = temporal.as_of(views.event_versions(spark, d), VALID_T, TX_T)
    return a.select("entity", "attribute", temporal.is_known().alias("known"), temporal.value_of().alias("value"))


# extraction and ingestion


def _turns(spark, d) -> DataFrame:
    return views.turns(spark, d).withColumn("observed_at", F.col("session") * 1000 + F.col("position"))


#: What the stand-in for a model answers to each turn, item by item.
SAID = r"""t AS (SELECT conv_id AS session, CAST(turn AS BIGINT) AS position, conv_id * 1000 + turn AS seen, coalesce(role, 'someone') AS speaker, left(text, 40) AS start, regexp_extract_all(coalesce(text, ''), '[^\s]+') AS w FROM conversations),
  g AS (SELECT *, len(w) AS n FROM t WHERE len(w) % 11 > 0),
  i AS (SELECT session, position, 'response' AS section, 0 AS item, NULL AS subject, NULL AS object, NULL AS kind, NULL AS name, NULL AS attribute, NULL AS predicate, NULL AS value, NULL AS text, NULL AS "at", 'unparsable' AS why FROM t WHERE len(w) % 11 = 0
  UNION ALL SELECT session, position, 'mentions', 0, NULL, NULL, 'person', speaker, NULL, NULL, NULL, start, NULL, NULL FROM g
  UNION ALL SELECT session, position, 'mentions', 1, NULL, NULL, 'thing', w[1], NULL, NULL, NULL, start, NULL, NULL FROM g
  UNION ALL SELECT session, position, 'facts', 0, 0, NULL, NULL, NULL, 'said', NULL, CASE WHEN n % 3 > 0 THEN w[n] END, start, seen - n % 5 * 86400000, NULL FROM g
  UNION ALL SELECT session, position, 'facts', 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'subject names no mention' FROM g
  UNION ALL SELECT session, position, 'facts', 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'value is not a string' FROM g
  UNION ALL SELECT session, position, 'relations', 0, CASE WHEN n % 7 > 0 THEN 0 END, CASE WHEN n % 7 > 0 THEN 1 END, NULL, NULL, NULL, CASE WHEN n % 7 > 0 THEN 'spoke_of' END, NULL, NULL, CASE WHEN n % 7 > 0 THEN seen END, CASE WHEN n % 7 = 0 THEN 'days_ago is negative' END FROM g
  UNION ALL SELECT session, position, 'relations', 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'an edge to itself' FROM g
  UNION ALL SELECT session, position, 'closures', 0, 0, NULL, NULL, NULL, NULL, 'spoke_of', NULL, 'over', seen, NULL FROM g WHERE n % 4 = 0)"""


@query(f"WITH {SAID} SELECT session, position, section, item, CAST(subject AS INTEGER) AS subject, CAST(object AS INTEGER) AS object, kind, name, attribute, predicate, value, text, CAST(\"at\" AS BIGINT) AS \"at\", why FROM i")
def extract_salvage(spark, d):
    return extract.extract(_turns(spark, d), extract.stub_completer)


@query("SELECT conv_id AS session, turn AS position, conv_id * 1000 + turn AS days_none, CASE WHEN turn < 0 THEN NULL ELSE conv_id * 1000 + turn - turn * 86400000 END AS days_turn FROM conversations")
def days_ago(spark, d):
    t = _turns(spark, d)
    none = F.lit(None).cast("long")
    return t.select("session", "position", extract.days_ago(none, F.col("observed_at")).alias("days_none"), extract.days_ago(F.col("position"), F.col("observed_at")).alias("days_turn"))


@query()
def ingest_turns(spark, d):
    from bitempo.streaming.ingest import ingest

    return ingest(_turns(spark, d), extract.stub_completer).versions


@query()
def closures_applied(spark, d):
    from bitempo.streaming.ingest import ingest

    return ingest(_turns(spark, d), extract.stub_completer).edges


@query("WITH t AS (SELECT conv_id AS session, turn AS position, role, text FROM conversations) SELECT session, position, EXISTS (SELECT 1 FROM t o WHERE o.session % 2 = 0 AND o.role = t.role AND o.text = t.text) AS cached FROM t")
def response_cache(spark, d):
    """Which turns need no completion once the even sessions' are cached."""
    t = _turns(spark, d)
    cache = extract.responses(t.where("session % 2 = 0"), extract.stub_completer)[1]
    answered, _ = extract.responses(t, extract.stub_completer, cache)
    return answered.join(cache.select("asked", F.lit(True).alias("hit")), "asked", "left").select("session", "position", F.coalesce("hit", F.lit(False)).alias("cached"))


@query("WITH c AS (SELECT conv_id AS session, turn AS position FROM conversations) SELECT session, position, 'facts' AS section, 0 AS item, 'subject names no mention' AS why FROM c WHERE position % 3 = 0 UNION ALL SELECT session, position, 'relations', 0, 'an edge to itself' FROM c WHERE position % 4 = 0 UNION ALL SELECT session, position, 'mentions', 1, 'a mention without a name' FROM c WHERE position % 5 = 0")
def validate_items(spark, d):
    """Extractions given whole, some with a fact of no mention, an edge to itself or a nameless mention."""
    t, p = views.turns(spark, d).select("session", "position"), F.col("position")
    row = lambda section, item, subject, object_, name: F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), subject.cast("int").alias("subject"), object_.cast("int").alias("object"), name.alias("name"))
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    items = F.array(row("mentions", 0, none, none, F.lit("A")), row("mentions", 1, none, none, F.when(p % 5 == 0, " ").otherwise("B")), row("facts", 0, F.when(p % 3 == 0, 2).otherwise(1), none, text), row("relations", 0, F.lit(0), F.when(p % 4 == 0, 0).otherwise(1), text), row("closures", 0, F.lit(1), none, text))
    return extract.validate(t.select("session", "position", F.inline(items)))


@query("WITH r AS (SELECT vec_id % 9 AS a, label % 3 AS ka, label % 2 AS kb FROM embeddings) SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (WHERE ka <> kb) AS BIGINT) AS different FROM r")
def kind_mismatch(spark, d):
    e = views.table(spark, d, "embeddings")
    a, b = F.col("vec_id") * 2, F.col("vec_id") * 2 + 1
    kinds = e.select(a.alias("id"), (F.col("label") % 3).alias("kind")).unionAll(e.select(b, F.col("label") % 2))
    return analytics.kind_mismatch(e.select(a.alias("a"), b.alias("b")), kinds)


@query(_topk(COSINE, 10).replace("WITH v AS", "WITH h AS (WITH v AS", 1) + ") SELECT query_id, count(*) FILTER (WHERE rank <= 7) / CAST(count(*) AS DOUBLE) AS recall FROM h GROUP BY 1")
def recall_against_exact(spark, d):
    """The share of the ten nearest that the seven nearest hold."""
    return analytics.overlap(_search(spark, d, 7), _search(spark, d, 10))


@query(f"WITH {SAID}, o AS (SELECT session, position, count(*) FILTER (WHERE section = 'mentions' AND why IS NULL) AS m, count(*) FILTER (WHERE section = 'relations' AND why IS NULL) AS r, count(*) FILTER (WHERE why LIKE '%names no mention%') AS u FROM i GROUP BY 1, 2) SELECT count(*) AS responses, CAST(count(*) FILTER (WHERE m = 0) AS BIGINT) AS none, CAST(count(*) FILTER (WHERE m >= 2) AS BIGINT) AS two_or_more, CAST(sum(r) AS BIGINT) AS relations, CAST(sum(u) AS BIGINT) AS unanchored FROM o")
def response_shape(spark, d):
    return analytics.response_shape(extract.extract(_turns(spark, d), extract.stub_completer))


# integrity and analytics


@query("SELECT CAST(NULL AS VARCHAR) AS check, CAST(0 AS BIGINT) AS rows WHERE false")
def integrity_violations(spark, d):
    return integrity.violations(integrity.Store.of(spark, d))


@query(f"WITH {VE}, n AS (SELECT session AS attribute, count(*) AS n FROM ve GROUP BY 1) SELECT count(*) AS attributes, CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS used_once, count(*) FILTER (WHERE n = 1) / CAST(count(*) AS DOUBLE) AS share_once, avg(n) AS per_name FROM n")
def attribute_sprawl(spark, d):
    return analytics.attribute_sprawl(views.event_versions(spark, d).withColumn("attribute", F.col("session")))


@query(f"WITH {VE}, n AS (SELECT entity, attribute, count(*) AS n FROM ve GROUP BY 1, 2) SELECT attribute, count(*) AS logs, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS contested, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS inside FROM n GROUP BY 1")
def contested_attributes(spark, d):
    return analytics.contested(views.event_versions(spark, d))


@query("WITH s AS (SELECT DISTINCT p_name, left(regexp_extract(lower(p_name), '^([a-z]+)', 1), 6) AS stem FROM part) SELECT stem, count(*) AS members FROM s WHERE length(stem) >= 4 GROUP BY 1 HAVING count(*) >= 3")
def stem_families(spark, d):
    return analytics.stem_families(views.table(spark, d, "part"), "p_name")


@query(_topk(COSINE, 11).replace("SELECT query_id, CAST(rank", "SELECT query_id, CAST(rank").replace("WITH v AS", "WITH h AS (WITH v AS", 1) + ") SELECT e.label AS category, count(DISTINCT e.vec_id) AS questions, count(DISTINCT CASE WHEN o.label = e.label THEN e.vec_id END) AS hit, count(DISTINCT CASE WHEN o.label = e.label THEN e.vec_id END) / CAST(count(DISTINCT e.vec_id) AS DOUBLE) AS recall FROM embeddings e LEFT JOIN h ON h.query_id = e.vec_id AND h.assertion_id <> e.vec_id LEFT JOIN embeddings o ON o.vec_id = h.assertion_id WHERE e.vec_id % 20 = 0 GROUP BY 1")
def recall_at_k(spark, d):
    v = views.vectors(spark, d).select("assertion_id", F.col("entity").alias("category"))
    hits = _search(spark, d, 11).where("query_id <> assertion_id").join(v.withColumnRenamed("category", "found"), "assertion_id")
    good = hits.join(v.withColumnRenamed("assertion_id", "query_id"), "query_id").where("found = category").select("query_id", "category", F.col("assertion_id").alias("evidence"))
    asked = v.where("assertion_id % 20 = 0").select(F.col("assertion_id").alias("query_id"), "category", F.lit(None).cast("long").alias("evidence"))
    return analytics.recall_at_k(hits, good.unionByName(asked))


@query("SELECT doc_id % 12 + 1 AS hour, count(*) AS n, CAST(sum(epoch_us(make_timestamp(2023, 5, CAST(doc_id % 28 + 1 AS BIGINT), CAST(doc_id % 12 + 12 - CASE WHEN doc_id % 12 + 1 = 12 THEN 11 ELSE -1 END AS BIGINT), 56, 0.0)) // 1000) AS BIGINT) AS total FROM labels GROUP BY 1")
def parse_when(spark, d):
    l = views.table(spark, d, "labels")
    text = F.concat((F.col("doc_id") % 12 + 1).cast("string"), F.lit(":56 pm on "), (F.col("doc_id") % 28 + 1).cast("string"), F.lit(" May, 2023"))
    return l.withColumn("at", analytics.parse_when(text)).groupBy((F.col("doc_id") % 12 + 1).alias("hour")).agg(F.count("*").alias("n"), F.sum("at").alias("total"))
