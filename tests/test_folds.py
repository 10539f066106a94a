"""Folds that skip what changes nothing, against folds of every mention and closure in turn."""

import random

import numpy as np
import pyarrow as pa
import pytest

from bitempo.operators.remember import _key, fold, fold_equal
from bitempo.operators.resolve import Blocking, Rule, Ruleset
from bitempo.streaming.ingest import folded

TURN = ("observed_at", "session", "position")


def _keys(record):
    return sorted(set((record.get("name") or "").split()))


@pytest.mark.parametrize("match_at", [1.0, 3.0, 6.0])
def test_equal_mentions_against_each_in_turn(match_at):
    """Records with a field more or less, entities known before, rejected pairs, copies that do not match each other."""
    rules = Ruleset((Rule("name", "token_jaccard", 0.9, 0.05), Rule("kind", "exact", 0.9, 0.4)), (Blocking("token", "name"),), -1.0, match_at)
    for seed in range(60):
        rng = random.Random(seed)
        pool = [{"name": " ".join(rng.choices("abcd", k=rng.randint(0, 3)))} | ({"kind": rng.choice("xy")} if rng.random() < 0.6 else {}) for _ in range(7)]
        mentions = [(i * 3, r, _keys(r)) for i, r in enumerate(rng.choices(pool, k=40))]
        known = [(e, r, _keys(r)) for e, r in enumerate(rng.choices(pool, k=rng.randint(0, 3)), 1)]
        refused = {frozenset((_key(a), _key(b))) for a, b in zip(rng.choices(pool, k=3), rng.choices(pool, k=3), strict=True)}
        want, held = fold(rules, mentions, refused, known)
        ids: dict = {}
        for i, r, k in mentions:
            ids.setdefault(_key(r), (r, k, []))[2].append(i)
        given = [(r, k, np.array(n)) for r, k, n in ids.values()]
        told, now = fold_equal(rules, given, refused, known)
        got = []
        for (_, _, n), parts in zip(given, told, strict=True):
            for i in n.tolist():
                at, e, o, d = [p for p in parts if p[0] <= i][-1]
                assert o == "merged" or at == i
                got.append((i, e, o, d))
        assert sorted(got) == want and now == held


def test_mentions_that_change_nothing_are_not_compared(monkeypatch):
    from bitempo.operators import remember

    calls = []
    bits = remember.bits
    monkeypatch.setattr(remember, "bits", lambda *a: calls.append(1) or bits(*a))
    rules = Ruleset((Rule("name", "exact", 0.9, 0.05),), (Blocking("token", "name"),), 0.0, 3.0)
    told, _ = fold_equal(rules, [({"name": n}, ["k"], np.arange(i, 100_000, 5)) for i, n in enumerate("abcde")])
    assert len(calls) == 25 and sum(map(len, told)) == 10


def _slow(events):
    """Each closure of a triple's events looked at in turn, as the log stands."""
    log = []
    for e in sorted(events, key=lambda r: (r["turn_observed_at"] is not None, tuple(r[f"turn_{c}"] for c in TURN) if r["turn_observed_at"] is not None else (), r["step"], r["nth"])):
        if e["step"] < 2:
            log.append(e)
        elif not any(v["step"] == 1 and all(v[f"turn_{c}"] == e[f"turn_{c}"] for c in TURN) for v in log):
            live = [(v["tx"], i) for i, v in enumerate(log) if v["valid_from"] <= e["valid_from"] and (v["valid_to"] is None or e["valid_from"] < v["valid_to"])]
            if live and log[max(live)[1]]["present"]:
                log.append(e | {"present": False})
    return [(i, v["present"], v["valid_from"], v["tx"]) for i, v in enumerate(log)]


@pytest.mark.parametrize("old", ["none", "plain", "late"])
def test_closures_against_each_in_turn(old):
    import pyarrow.compute as pc

    types = {"object": pa.int64(), "step": pa.int32(), "nth": pa.int64(), "present": pa.bool_(), "valid_from": pa.int64(), "valid_to": pa.int64(), "tx": pa.int64(), "turn_observed_at": pa.int64(), "turn_session": pa.string(), "turn_position": pa.int64()}
    for seed in range(150):
        rng = random.Random(seed)
        rows = []
        for o in range(3):
            for n in range(rng.randint(0, 4) if old != "none" else 0):
                tx = n if old == "plain" else rng.randint(0, 60)
                rows.append(dict.fromkeys(types) | {"object": o, "step": 0, "nth": n, "present": rng.random() < 0.7, "valid_from": rng.randint(0, 40), "valid_to": rng.randint(30, 60) if old == "late" and rng.random() < 0.3 else None, "tx": tx})
        for at in sorted(rng.choices(range(10, 50), k=25)):
            place = {"turn_observed_at": at, "turn_session": rng.choice("ab"), "turn_position": rng.randint(0, 3)}
            for n in range(rng.randint(0, 2)):
                rows.append(dict.fromkeys(types) | place | {"object": rng.randint(0, 2), "step": 1, "nth": n, "present": True, "valid_from": at - rng.choice([0, 0, 1, 9]), "tx": at})
            for n in range(rng.randint(0, 2)):
                rows.append(dict.fromkeys(types) | place | {"step": 2, "nth": n, "valid_from": at - rng.choice([0, 0, 2, 12]), "tx": at})
        t = pa.Table.from_pylist(rows, pa.schema(list(types.items())))
        t = t.take(pc.sort_indices(t, [*[(f"turn_{c}", "ascending") for c in TURN], ("step", "ascending"), ("nth", "ascending")], null_placement="at_start"))
        seqs, kept, (tombs, ended) = folded(t)
        objects = {i: o for i, o in zip(tombs, ended, strict=True)}
        got = {o: [] for o in range(3)}
        for i, (s, k) in enumerate(zip(seqs, kept, strict=True)):
            r = t.slice(k, 1).to_pylist()[0]
            got[objects.get(i, r["object"])].append((s, False if i in objects else r["present"], r["valid_from"], r["tx"]))
        sorted_rows = t.to_pylist()
        for o in range(3):
            if any(r["object"] == o for r in rows):
                assert got[o] == _slow([r for r in sorted_rows if r["object"] in (o, None)])
