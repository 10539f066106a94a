"""Results for every record where only distinct ones are compared, against comparing all."""

import os

import pytest
from pyspark.sql import functions as F

from bitempo.operators import resolve
from bitempo.queries import RULES, Q

D = "/root/testdata/sf0.001"
NAMES = ["red green blue", "red green blue", "red green blue", "red green", "red green", "red", "grey stone", "grey stone", "pink", None, None, "", "green red blue"]
#: Copies of one record are only to be reviewed under these.
DOUBT = resolve.Ruleset((resolve.Rule("name", "token_jaccard", 0.9, 0.05),), (resolve.Blocking("token", "name"),), -0.9, 9.0)


@pytest.mark.parametrize("rules", [RULES, DOUBT])
def test_copies_against_all_pairs(spark, rules):
    df = spark.createDataFrame([(10 + i, n) for i, n in enumerate(NAMES)], "id long, name string").select("id", F.create_map(F.lit("name"), "name").alias("record"))
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(resolve.resolve_copies(df, rules).select("id", "cluster")) == rows(resolve.resolve(df, rules)[0].select("id", "cluster"))
    brute = resolve.scored_pairs(df, rules).groupBy("decision").agg(F.count("*").alias("pairs"))
    assert rows(resolve.weighted_bands(df, rules).select("decision", "pairs")) == rows(brute.select("decision", "pairs"))


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
def test_every_part_is_a_mention(spark):
    parts = spark.read.parquet(f"{D}/part.parquet")
    n, names = parts.count(), parts.select("p_name").distinct().count()
    got = Q["remember_incremental"](spark, D).collect()
    assert len(got) == n > names and sum(r.outcome == "merged" for r in got) >= n - names
    assert Q["resolve_members"](spark, D).count() == n


def _brute(rows, rules):
    """Every pair that shares a key, compared in plain Python, the earlier record on the left."""
    from bitempo.operators.remember import bits

    out = []
    for i, x in rows:
        for j, y in rows:
            if i < j and x and y and set(x.split()) & set(y.split()):
                s = bits(rules, {"name": x}, {"name": y})
                out.append((i, j, round(s, 6), "match" if s >= rules.match_at else "review" if s >= rules.review_at else "non_match"))
    return sorted(out)


@pytest.mark.parametrize("most", [1, 2, 1024])
@pytest.mark.parametrize("match_at", [3.0, 5.0])
def test_pairs_of_copies_against_brute_force(spark, monkeypatch, most, match_at):
    """A comparator that counts the left side's tokens is not symmetric, so the order of each two records must tell."""
    rules = resolve.Ruleset((resolve.Rule("name", "token_jaccard", 0.9, 0.05),), (resolve.Blocking("token", "name"),), -0.9, match_at)
    names = ["a a b", "a b", "a a b", "a b", "a c", None, "c", "a c", "a a b", "d", "d", "a b", "c c a"]
    rows = list(enumerate(names))
    df = spark.createDataFrame(rows, "id long, name string").select("id", F.create_map(F.lit("name"), "name").alias("record"))
    bundles = resolve.bundles
    monkeypatch.setattr(resolve, "bundles", lambda r, b, m=most: bundles(r, b, min(m, most)))
    want = _brute(rows, rules)
    assert any(x[3] != y[3] for x in want for y in want if (names[x[0]], names[x[1]]) == (names[y[1]], names[y[0]])), "some decision depends on the order"
    assert sorted(tuple(r) for r in resolve.scored_pairs(df, rules, 6).collect()) == want
    counts = {d: sum(w[3] == d for w in want) for d in {w[3] for w in want}}
    assert {r.decision: r.pairs for r in resolve.weighted_bands(df, rules).collect()} == counts
    clusters, review = resolve.resolve(df, rules)
    name = {i: i for i, _ in rows}
    for _ in rows:
        for a, b, _, d in want:
            if d == "match":
                name[a] = name[b] = min(name[a], name[b])
    assert {r.id: r.cluster for r in clusters.collect()} == name
    assert sorted((r.a, r.b, round(r.score, 6)) for r in review.collect()) == [(a, b, s) for a, b, s, d in want if d == "review" and name[a] != name[b]]


def test_pairs_are_not_shuffled(spark):
    """What is exchanged is in proportion to the records, not to their pairs."""
    df = spark.range(3000).select("id", F.create_map(F.lit("name"), F.lit("a"), F.lit("n"), (F.col("id") % 3).cast("string")).alias("record"))
    rules = resolve.Ruleset((resolve.Rule("name", "exact", 0.9, 0.05),), (resolve.Blocking("exact", "name"),), -0.9, 3.0)
    out = resolve.scored_pairs(df, rules)
    assert out.count() == 3000 * 2999 // 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")], "no distinct above the join"


def test_edges_are_read_once_for_counts(spark):
    """What survivors take over is told from one pass over the edges, and tasks take shares of a fixed number."""
    from bitempo.operators import mutations

    edges = spark.createDataFrame([(1, "p", 2), (2, "p", 1), (3, "p", 2), (3, "p", 2), (4, "q", 5)], "subject long, predicate string, object long")
    merged = spark.createDataFrame([(2, 1), (5, 4)], "absorbed long, kept long")
    out = mutations.repointed(edges, merged)
    assert sorted(map(tuple, out.collect())) == [(1, 3), (4, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [subject") == 1
