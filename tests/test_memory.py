"""A memory over several batches: identity, closures, merges, writes and the store."""

import json

import pytest
from pyspark.sql import functions as F

from bitempo.operators import mutations
from bitempo.operators.extract import prompt, prompted
from bitempo.operators.memory import Memory
from bitempo.operators.mutations import UnknownEntity
from bitempo.operators.remember import remember_into
from bitempo.operators.resolve import Blocking, Rule, Ruleset
from bitempo.plans.numbering import number
from bitempo.providers import HttpProvider, Network, ProviderError, parse_completion, parse_embedding, retry_after
from bitempo.server import MODERN, TOOLS, VERSION_KEY, Server
from bitempo.sources import integrity
from bitempo.sources.storage import Snapshots
from bitempo.streaming.ingest import ingest

NAMES = Ruleset((Rule("name", "exact", 0.9, 0.01), Rule("kind", "exact", 0.9, 0.38)), (Blocking("prefix", "name", 3),), 5.2, 7.2)
DAY = 86_400_000
TURN = "session string, position long, speaker string, text string, observed_at long"


#: A turn's text is its response.
model = lambda text, speaker: text


def turn(at, mentions, relations=(), closures=(), facts=()):
    return ("s", at, None, json.dumps({"mentions": [{"kind": "person", "name": n, "text": n} for n in mentions], "facts": [{"subject": s, "attribute": a, "value": v, "text": v} for s, a, v in facts], "relations": [{"subject": a, "predicate": p, "object": b, "days_ago": d} for a, p, b, d in relations], "closures": [{"subject": a, "predicate": p, "because": "over", "days_ago": d} for a, p, d in closures]}), at * DAY)


def taken(memory):
    order = lambda df, *c: [tuple(r) for r in df.orderBy(*c).collect()]
    return (
        order(memory.entities, "entity"),
        order(memory.versions.drop("assertion_id"), "entity", "attribute", "seq"),
        order(memory.edges, "subject", "predicate", "object", "seq"),
        [(r.entity, sorted(r.record.items())) for r in memory.identity.orderBy("entity").collect()],
        order(memory.reviews, "review"),
    )


def test_two_batches_are_one(spark):
    turns = [
        turn(100, ["Ada Quill", "Mill"], [(0, "works_at", 1, 0)], facts=[(0, "likes", "tea")]),
        turn(101, ["Adam Ruiz", "Ada Quill"], facts=[(1, "likes", "rain")]),
        turn(102, ["Ada Quill", "Forge"], [(0, "works_at", 1, 0)], [(0, "works_at", 0)]),
        turn(103, ["Lou Marsh", "Ada Quill"], [(1, "knows", 0, 2)]),
        turn(104, ["Ada Quill"], closures=[(0, "knows", 0)]),
    ]
    whole = ingest(spark.createDataFrame(turns, TURN), model, NAMES).memory
    parts = None
    for rows in (turns[:2], turns[2:3], turns[3:]):
        parts = ingest(spark.createDataFrame(rows, TURN), model, NAMES, parts).memory
    assert taken(whole) == taken(parts)
    assert whole.entity_count() == 5
    closed = whole.edges.where("not present").orderBy("valid_from").collect()
    assert [(e.predicate, e.valid_from, e.source, e.because) for e in closed] == [("works_at", 102 * DAY, "agent_inference", "over"), ("knows", 104 * DAY, "agent_inference", "over")]


def test_every_closure_is_looked_at(spark):
    """An edge from day 100, a closure for day 96, then one for day 102: the second ends it."""
    turns = [turn(100, ["Ada", "Mill"], [(0, "at", 1, 0)]), turn(101, ["Ada"], closures=[(0, "at", 5)]), turn(102, ["Ada"], closures=[(0, "at", 0)]), turn(103, ["Ada"], closures=[(0, "at", 0)])]
    edges = ingest(spark.createDataFrame(turns, TURN), model, NAMES).edges.orderBy("seq").collect()
    assert [(e.present, e.valid_from) for e in edges] == [(True, 100 * DAY), (False, 102 * DAY)]


def test_rejected_pairs_stay_rejected(spark):
    rules = Ruleset((Rule("name", "jaro_winkler", 0.9, 0.01),), (Blocking("prefix", "name", 3),), 3.0, 6.4)
    m = lambda *names: spark.createDataFrame([(i, {"name": n}) for i, n in enumerate(names)], "id long, record map<string,string>")
    one = remember_into(m("Marianne", "Marian"), rules)
    assert [(r.a, r.b) for r in one.reviews.collect()] == [(1, 2)]
    rejected = spark.createDataFrame([(1, 2)], "a long, b long")
    again = remember_into(m("Marianna"), rules, one.identity, rejected)
    assert again.reviews.count() == 2, "another spelling is another question"
    hidden = rules
    known = spark.createDataFrame([(1, {"name": "Marianne"}), (7, {"name": "Marian"})], "entity long, record map<string,string>")
    only = known.where("entity = 1")
    asked = remember_into(m("Marian"), hidden, only, None)
    assert [(r.a, r.b) for r in asked.reviews.collect()] == [(1, 2)]
    told = remember_into(m("Marian"), Ruleset(rules.rules, rules.blocking, 3.0, 99.0), known, spark.createDataFrame([(1, 7)], "a long, b long"))
    assert {(r.a, r.b) for r in told.reviews.collect()} == {(7, 8)}, "the pair of records was answered before"


def test_confirm_follows_chains(spark):
    rows = [(1, "a", 0, 5), (2, "a", 0, 5), (2, "a", 1, 9), (3, "a", 0, 5), (3, "b", 0, 1)]
    e = Memory.empty(spark)
    versions = mutations.filled(spark.createDataFrame([(i, at, s, f"v{i}{s}", t, t, "value") for i, at, s, t in rows], "entity long, attribute string, seq long, value string, valid_from long, tx long, state string"), e.versions).select(*e.versions.columns).withColumn("assertion_id", F.col("entity") * 10 + F.col("seq"))
    edge = spark.createDataFrame([(3, "p", 4, 0, True, 1, None, 1), (2, "p", 4, 0, True, 1, None, 0), (3, "q", 1, 0, True, 1, None, 1)], "subject long, predicate string, object long, seq long, present boolean, valid_from long, valid_to long, tx long")
    edges = mutations.filled(edge, e.edges).select(*e.edges.columns)
    identity = spark.createDataFrame([(1, {"name": "x"}), (2, {"name": "y", "kind": "k"}), (3, {"name": "z", "kind": "l", "age": "9"}), (4, {"name": "w"})], "entity long, record map<string,string>")
    reviews = spark.createDataFrame([(1, 2, 3, 1.0), (2, 1, 2, 1.0), (3, 3, 4, 1.0), (4, 2, 4, 1.0)], "review long, a long, b long, score double")
    rejected = spark.createDataFrame([(3, 4), (1, 3)], "a long, b long")
    entities = spark.createDataFrame([(i, "k", 0) for i in range(1, 5)], "entity long, kind string, created_at long")
    m = Memory(entities, versions, edges, identity, e.vectors, reviews, rejected).confirm(spark.createDataFrame([(1,), (2,)], "review long"))
    assert [(r.seq, r.value, r.assertion_id) for r in m.versions.where("attribute = 'a'").orderBy("seq").collect()] == [(0, "v10", 10), (1, "v20", 20), (2, "v21", 21), (3, "v30", 30)]
    assert {r.entity for r in m.versions.collect()} == {1}
    assert [(r.subject, r.object, r.seq, r.tx) for r in m.edges.orderBy("seq").collect()] == [(1, 4, 0, 0), (1, 4, 1, 1)]
    assert {r.entity: r.record for r in m.identity.collect()} == {1: {"name": "x", "kind": "k", "age": "9"}, 4: {"name": "w"}}
    assert [(r.review, r.a, r.b) for r in m.pending_review().collect()] == [(3, 1, 4)] and [(r.a, r.b) for r in m.rejected.collect()] == [(1, 4)]
    with pytest.raises(UnknownEntity):
        m.confirm(spark.createDataFrame([(99,)], "review long"))


def test_writes_are_whole(spark):
    m = Memory.empty(spark, dim=2)
    new = spark.createDataFrame([("person", 5, "b"), ("person", 5, "a")], "kind string, created_at long, name string").withColumn("record", F.create_map(F.lit("name"), "name"))
    m = m.create(new, ["name"])
    assert {r.entity: r.record["name"] for r in m.identity.collect()} == {1: "a", 2: "b"}
    row = "entity long, attribute string, state string, value string, valid_from long, valid_to long, tx long, source string, session string, vector array<double>"
    m = m.write(spark.createDataFrame([(1, "x", "value", "p", 1, None, 1, "u", "s", [3.0, 4.0]), (1, "x", "value", "q", 2, None, 2, "u", "s", [0.0, 2.0])], row), ["tx"])
    assert m.index_len() == 2 and m.index_shape() == (2, "cosine") and m.assertion(2).first().value == "q" and 2 in m.index()
    for bad in ([(9, "x", "value", "p", 1, None, 1, "u", "s", [1.0, 1.0])], [(1, "x", "value", "p", 1, None, 1, "u", "s", [0.0, 0.0])]):
        with pytest.raises(ValueError):
            m.write(spark.createDataFrame(bad, row), ["tx"])
    gone = spark.createDataFrame([(1, "x")], "entity long, attribute string")
    quiet = m.forget(gone, 9, "user_assertion", "s")
    assert quiet.index_len() == 0 and quiet.versions.count() == 3
    left, lost = m.erase(gone)
    assert left.index_len() == 0 and left.versions.count() == 0 and lost.first().erased == 2
    assert not integrity.violations(integrity.of_memory(m)).collect()
    with pytest.raises(UnknownEntity):
        m.erase(spark.createDataFrame([(77, "x")], "entity long, attribute string"))


def test_store(spark, tmp_path):
    m = Memory.empty(spark, dim=2)
    store = Snapshots(spark, str(tmp_path / "m"), wait=0.2)
    assert store.open(2, "cosine").entity_count() == 0
    store.save(m)
    store.save(m)
    assert store.shape() == (2, "cosine")
    with pytest.raises(ValueError):
        store.open(3, "cosine")
    lock = tmp_path / "m" / "lock"
    lock.write_text("")
    with pytest.raises(RuntimeError, match="another writer"):
        store.save(m)
    assert Snapshots(spark, str(tmp_path / "m"), lease=0.0).save(m) == 3, "a lock left by a crash is taken over"


def test_numbers(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 37) % 1000).repartition(7)
    got = number(df, ["x"], "n", 5).collect()
    assert all(r.n == r.x + 5 for r in got) and len(got) == 1000
    assert number(df.where("false"), ["x"], "n").count() == 0


def test_server():
    class Fake:
        def about(self, entity, attribute, valid_t, tx_t):
            return {"state": "value", "value": f"{entity} {attribute} {valid_t} {tx_t}", "reason": None}

        def settle(self, review, same):
            raise ValueError(f"no open review {review}")

    s = Server(Fake())
    ask = lambda **m: json.loads(s.handle(json.dumps({"jsonrpc": "2.0", **m}), 7))
    assert json.loads(s.handle("{", 7))["error"]["code"] == -32700
    assert s.handle(json.dumps({"jsonrpc": "2.0", "method": "notifications/cancelled"}), 7) is None
    assert ask(id=None, method="ping")["error"]["code"] == -32600 and ask(id=1, method="none")["error"]["code"] == -32601
    assert ask(id=1, method="initialize", params={"protocolVersion": "2024-11-05"})["result"]["protocolVersion"] == "2024-11-05"
    call = lambda name, args, **p: ask(id="x", method="tools/call", params={"name": name, "arguments": args, **p})
    out = call("about", {"entity": 3, "attribute": "age", "as_of": 5})["result"]
    assert out["content"][0]["text"] == "3 age 7 5" and "structuredContent" not in out and not out["isError"]
    assert call("about", {"entity": -1, "attribute": "age"})["result"]["isError"] and call("about", {"entity": True, "attribute": "age"})["result"]["isError"]
    assert call("resolve_review", {"id": 4, "same": True})["result"]["content"][0]["text"] == "no open review 4"
    assert call("nothing", {})["error"]["code"] == -32602
    meta = {VERSION_KEY: MODERN, "io.modelcontextprotocol/clientCapabilities": {}}
    assert ask(id=2, method="tools/list", params={"_meta": meta})["result"]["resultType"] == "complete"
    assert ask(id=2, method="ping", params={"_meta": {VERSION_KEY: "1999-01-01"}})["error"]["code"] == -32022
    assert ask(id=2, method="ping", params={"_meta": {VERSION_KEY: MODERN}})["error"]["code"] == -32602
    assert [t["name"] for t in TOOLS] == ["remember", "recall", "about", "reviews", "resolve_review"]


def test_provider():
    key, waits = "sk-abcdef-0123456789-wxyz", []

    def provider(*answers, **options):
        queue = list(answers)
        return HttpProvider("http://h/v1", key, "c", "e", send=lambda url, body: queue.pop(0), sleep=waits.append, **options)

    good = (200, {}, json.dumps({"choices": [{"message": {"content": "yes"}}]}))
    assert provider((500, {}, ""), (429, {"retry-after": "3"}, ""), good).complete("x") == "yes" and waits == [0.25, 3.0]
    for answer in ((401, {}, f"bad key {key}"), (429, {"retry-after": "3600"}, f"sk-abcde***wxyz {key}")):
        with pytest.raises(ProviderError) as e:
            provider(answer, good).complete("x")
        assert key not in str(e.value) and "wxyz" not in str(e.value)
    assert key not in repr(provider())
    assert parse_embedding('{"data": [{"embedding": [1, 2.5]}]}') == [1.0, 2.5] and parse_completion('{"choices": [{"message": {"content": ""}}]}') == ""
    for body in ('{"error": {"message": "m"}, "data": [{"embedding": [1]}]}', '{"data": []}', "[]", '{"data": [{"embedding": "x"}]}'):
        with pytest.raises(ProviderError):
            parse_embedding(body)
    assert retry_after({"retry-after": "nan"}) is None and retry_after({"retry-after": "-1"}) is None
    env = {"HTTP_PROXY": "http://evil", "https_proxy": "http://p:1", "NO_PROXY": ".in.house, x.org"}
    n = Network.from_env(env.get)
    assert n.proxy == "http://p:1" and n.bypasses("a.in.house") and n.bypasses("127.0.0.1") and n.bypasses("[::1]") and not n.bypasses("y.org")
    assert prompted(lambda p: p)("hello", "Ann") == prompt("Ann", "hello")
