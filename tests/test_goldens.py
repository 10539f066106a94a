"""Golden cases of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from bitempo.functions.text import _plain, compare, jaro_of, jaro_winkler_of, normalize, possessive_aware_of, possessive_parts_of, token_jaccard
from bitempo.operators import analytics, mutations, remember, survivorship, temporal
from bitempo.operators.extract import Unparsable, resolve_days, salvage
from bitempo.operators.graph import Walk, neighborhood
from bitempo.operators.resolve import Blocking, Rule, Ruleset, candidate_pairs, resolve
from bitempo.operators.survivorship import Policy, Strategy
from bitempo.sources import integrity
from bitempo.sources.storage import Snapshots

V = "entity long, attribute string, seq long, state string, value string, valid_from long, valid_to long, tx long, source string, session string"
E = "subject long, predicate string, object long, seq long, present boolean, valid_from long, valid_to long, tx long"


def log(spark, *rows, attribute="employer"):
    return spark.createDataFrame([(1, attribute, i, "absent" if v is None else "value", v, f, None, tx, s, "s") for i, (v, f, tx, s) in enumerate(rows)], V)


def facts(spark, *rows):
    return log(spark, *[(v, tx, tx, "user_assertion") for v, tx in rows])


def held(df):
    r = df.collect()[0]
    return r.state, r.value


def test_as_of_on_two_axes(spark):
    v = log(spark, ("Mill", 1, 3, "u"), ("Forge", 7, 9, "u"))
    for valid, tx, want in ((8, 8, "Mill"), (8, 10, "Forge"), (2, 10, "Mill")):
        assert held(temporal.as_of(v, valid, tx)) == ("value", want)
    late = log(spark, ("Forge", 1, 9, "u"))
    assert held(temporal.as_of(late, 3, 3)) == ("unknown", None) and held(temporal.as_of(late, 3, 10)) == ("value", "Forge")
    assert held(temporal.as_of(log(spark, ("x", 1, 1, "u"), (None, 7, 7, "u")), 10, 10)) == ("absent", None)


def test_timeline(spark):
    spans = survivorship.timeline(facts(spark, ("acme", 100), ("globex", 200), ("acme", 300))).orderBy("opens").collect()
    assert [(s.value, s.opens, s.closes) for s in spans] == [("acme", 100, 200), ("globex", 200, 300), ("acme", 300, None)]
    gap = facts(spark, ("Mill", 10), (None, 20), ("Forge", 30))
    at = lambda t: held(survivorship.held_at(gap, Strategy.VALID_INTERVAL, t))
    assert at(15) == ("value", "Mill") and at(25) == ("absent", None) and at(35) == ("value", "Forge") and at(5) == ("unknown", None)
    assert survivorship.timeline(facts(spark, ("a", 1), ("b", 1))).collect()[0].state == "refused"


def test_strategies(spark):
    assert held(survivorship.longest(facts(spark, ("café", 1), ("abcde", 2)))) == ("value", "abcde")
    assert held(survivorship.plurality(facts(spark, ("b", 1), ("a", 2), ("a", 3), ("b", 4)))) == ("value", "b")
    assert held(survivorship.unanimous(facts(spark, ("a", 1), ("b", 2)))) == ("unknown", None)
    assert held(survivorship.most_recent(facts(spark, ("a", 1), ("b", 2), ("c", 2)))) == ("refused", None)
    assert held(survivorship.most_recent(facts(spark, ("a", 2), ("a", 2)))) == ("value", "a")
    two = log(spark, ("a", 1, 1, "user_assertion"), ("b", 1, 5, "tool_output"))
    assert held(survivorship.source_priority(two, ["user_assertion", "tool_output"])) == ("value", "a")
    assert held(survivorship.source_priority(two, ["user_assertion"])) == ("refused", None)
    assert held(survivorship.source_priority(two, [])) == ("refused", None)
    assert held(survivorship.source_priority(facts(spark, ("a", 1), ("a", 2)), [])) == ("value", "a"), "agreement comes before refusal"
    assert Strategy.MOST_RECENT.needs_provenance and not Strategy.MAJORITY_VOTE.needs_provenance
    story = facts(spark, ("Mill", 1710000000000), ("Forge", 1720000000000))
    p = Policy(Strategy.VALID_INTERVAL)
    may, august = 1715000000000, 1725000000000
    assert held(survivorship.about(story, p, may, august)) == ("value", "Mill") and held(survivorship.about(story, p, august, august)) == ("value", "Forge")
    assert [r.superseded for r in survivorship.superseded(story).orderBy("seq").collect()] == [True, False]


def test_comparators(spark):
    for a, b, j, w in (("martha", "marhta", 0.94444, 0.96111), ("dwayne", "duane", 0.82222, 0.84), ("dixon", "dicksonx", 0.76667, 0.81333)):
        assert round(jaro_of(a, b), 5) == j and round(jaro_winkler_of(a, b), 5) == w
    assert jaro_of("", "") == 1.0 and jaro_of("", "abc") == 0.0 and jaro_winkler_of("jonathan", "jose") == jaro_of("jonathan", "jose") < 0.7
    texts = {"  Tin-foil,  Ltd.\t": "tinfoil ltd", "D'Arcy": "darcy", "Zoë": "zoë", "North,South": "northsouth", "North, South": "north south", "ΛΟΓΟΣ": "λογοσ", "किताब": "किताब"}
    assert {t: _plain(t) for t in texts} == texts, "both normalisers agree"
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == texts
    pairs = spark.createDataFrame([("Ada Quill", "quill, ADA", 1.0), ("Lark", "Lark River Works", 1 / 3), ("x x", "x", 2.0), ("x", "x x", 0.5)], "a string, b string, w double")
    assert all(abs(r.w - r.j) < 1e-9 for r in pairs.withColumn("j", token_jaccard(F.col("a"), F.col("b"))).collect())
    parts = {"Ada's kite": ("Ada", "kite"), "two foxes' den": ("two foxes", "den"), "Zoë\u2019s  red cup": ("Zoë", "red cup"), "Luis' boat": ("Luis", "boat"), "salt 'n' pepper": ("salt 'n", "pepper"), "it 's done": ("it ", "done"), "Our, garden": ("Our,", "garden"), "your\tlamp": ("your", "lamp"), "D'Arcy": (None, "D'Arcy"), "Tony's": (None, "Tony's"), " his ": (None, "his"), "'s end": (None, "'s end"), "'' x": ("'", "x")}
    assert {k: possessive_parts_of(k) for k in parts} == parts
    assert possessive_aware_of("Ada", "Ada's kite") == 0.0 and possessive_aware_of("Ada's kite", "ada's KITE") == 1.0 and possessive_aware_of("Ada's kite", "Umberto's kite") < 0.7
    assert pairs.select(compare("possessive_aware", F.col("a"), F.col("b")).alias("s")).count() == 4


def test_resolution(spark):
    rules = Ruleset((Rule("name", "token_jaccard", 0.9, 0.05),), (Blocking("token", "name"),), -2.0, 4.0)
    r = spark.createDataFrame([(1, {"name": "Ida Marsh"}), (2, {"name": "Lou Marsh"}), (3, {"name": "Marsh Ida"})], "id long, record map<string,string>")
    clusters, review = resolve(r, rules)
    assert {x.id: x.cluster for x in clusters.collect()} == {1: 1, 2: 2, 3: 1}
    assert {(x.a, x.b) for x in review.collect()} == {(1, 2), (2, 3)} and all(-2 <= x.score < 0 for x in review.collect())
    told, reviews = remember.remember(r, rules)
    assert {x.mention: (x.entity, x.outcome) for x in told.collect()} == {1: (1, "created"), 2: (2, "created_pending_review"), 3: (1, "merged")}
    assert [(x.a, x.b) for x in reviews.collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        Ruleset((Rule("name", "exact", 0.1, 0.9),), (), 0, 1)


def test_large_blocks_lose_no_pair(spark):
    names = [f"{'mill' if i % 3 else 'forge'} {i % 7}" for i in range(60)]
    r = spark.createDataFrame([(i, {"name": n}) for i, n in enumerate(names)], "id long, record map<string,string>")
    shared = {(a, b) for a in range(60) for b in range(a + 1, 60) if set(names[a].split()) & set(names[b].split())}
    for big in (1, 7, 2048):
        found = [(x.a, x.b) for x in candidate_pairs(r, (Blocking("token", "name"),), big).collect()]
        assert len(found) == len(set(found)) and set(found) == shared


def test_walks(spark):
    e = spark.createDataFrame([(i, "knows", i + 1, 0, True, 1, None, 1) for i in range(1, 4)] + [(3, "knows", 4, 1, False, 2, None, 2)], E)
    nodes = spark.createDataFrame([(i,) for i in range(1, 5)], "entity long")
    seeds = spark.createDataFrame([(1,), (99,)], "entity long")
    go = lambda **o: [(r.entity, r.distance, r.truncated) for r in neighborhood(e, nodes, seeds, Walk(5, 5, **o)).orderBy("distance", "entity").collect()]
    assert go(hops=0, budget=10) == [(1, 0, False)] and go(hops=9) == [(1, 0, False), (2, 1, False), (3, 2, False)]
    assert go(hops=9, budget=2) == [(1, 0, True), (2, 1, True)] and go(hops=3, budget=0) == [] and go(hops=3, via=()) == [(1, 0, False)]


def test_writes(spark):
    e = spark.createDataFrame([(1, "p", 2, 0, True, 1, None, 1), (3, "p", 2, 0, True, 5, None, 5), (1, "p", 3, 0, True, 1, None, 1)], E)
    merged = spark.createDataFrame([(3, 1)], "absorbed long, kept long")
    got = [(r.subject, r.object, r.seq, r.tx) for r in mutations.repoint_edges(e, merged).orderBy("seq").collect()]
    assert got == [(1, 2, 0, 1), (1, 2, 1, 5)], "the self-edge goes, the logs come together"
    gone = mutations.unrelate(e, e.where("subject = 3"), 9)
    assert {(r.subject, r.object) for r in temporal.in_force(gone, 10, 10).collect()} == {(1, 2), (1, 3)}
    with pytest.raises(ValueError):
        mutations.relate(e, spark.createDataFrame([(1, "p", 1, 0, None, 0)], "subject long, predicate string, object long, valid_from long, valid_to long, tx long"))
    v = facts(spark, ("a", 1), ("b", 2))
    kept, vectors = mutations.forget_attribute(v, v, v, 9, "user_assertion", "s")
    assert kept.count() == 3 and vectors.count() == 0 and held(temporal.as_of(kept, 10, 10)) == ("absent", None)
    assert mutations.erase_attribute(v, v)[0].count() == 0


def test_salvage():
    bad = {"mentions": [], "facts": [{"subject": 0, "attribute": "a", "value": "v", "text": "t"}], "relations": [], "closures": []}
    assert [x["why"] for x in salvage(json.dumps(bad), 0)] == ["subject names no mention"]
    flag = {"mentions": [{"kind": "person", "name": "A", "text": "t"}], "facts": [{"subject": 0, "attribute": "a", "value": True, "text": "t"}, {"subject": 0, "attribute": "a", "text": "t"}]}
    got = salvage(json.dumps(flag), 5)
    assert got[1]["why"] == "value is not a string" and got[2]["why"] is None and got[2]["value"] is None and got[2]["at"] == 5
    for prose in ("I found nothing.", "```json\n{}\n```", "[]"):
        with pytest.raises(Unparsable):
            salvage(prose, 0)
    for broken in ('{"mentions": [NaN]}', '{"facts": Infinity}'):
        with pytest.raises(Unparsable):
            salvage(broken, 0)
    far = {"mentions": flag["mentions"], "facts": [{"subject": 0, "attribute": "a", "value": "v", "text": "t", "days_ago": d} for d in (1 << 63, 1 << 62, 1.0)]}
    got = salvage(json.dumps(far), 5)[1:]
    assert [x["why"] for x in got] == ["days_ago is not a whole number", None, "days_ago is not a whole number"] and got[1]["at"] == -(1 << 63)
    assert resolve_days(2, 0) == -2 * 86_400_000 and resolve_days(-1, 0) is None


def test_integrity_finds_what_is_broken(spark):
    d = "/root/testdata/sf0.001"
    s = integrity.Store.of(spark, d)
    s.vectors = s.vectors.where("assertion_id <> 3")
    s.edges = s.edges.unionByName(spark.createDataFrame([(7, "p", 7, 0, True, 0, None, 0)], E))
    assert {r.check for r in integrity.violations(s).collect()} >= {"an assertion without a vector", "an edge to itself"}


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "m"))
    assert store.read("versions") is None
    store.commit({"versions": facts(spark, ("a", 1))})
    store.commit({"versions": facts(spark, ("a", 1), ("b", 2))}, batch=4)
    assert store.read("versions").count() == 2 and store.batches() == {4}
    with pytest.raises(RuntimeError):
        store.commit({"versions": facts(spark, ("a", 1)).select(F.raise_error(F.lit("no")).alias("x"))})
    assert store.read("versions").count() == 2, "a commit that fails changes nothing"


def test_parse_when(spark):
    df = spark.createDataFrame([("1:56 pm on 8 May, 2023",), ("soon",)], "t string").select(analytics.parse_when(F.col("t")).alias("at"))
    assert [r.at for r in df.collect()] == [1683554160000, None]
