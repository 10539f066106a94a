"""Order-dependent identity: each mention meets the entities known before it.

Mentions interact only through shared blocking keys, so the connected components of
the graph of mentions and keys never meet: each is folded in order in a task of its
own, with the same result as one long sequential fold.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.functions.text import _plain as _plain_of
from bitempo.functions.text import jaro_winkler_of, possessive_aware_of
from bitempo.operators.resolve import COUNTED, Ruleset, all_keys, bundles
from bitempo.plans.components import connected_components
from bitempo.plans.loops import cut
from bitempo.plans.numbering import number


_plain = lru_cache(1 << 14)(_plain_of)


def _tokens_jaccard(a: str, b: str) -> float:
    x, y = [t for t in _plain(a).split(" ") if t], [t for t in _plain(b).split(" ") if t]
    if not x and not y:
        return 1.0
    both = sum(t in y for t in x)
    rest = len(x) + len(y) - both
    return both / rest if rest else 0.0


COMPARE: dict[str, Callable[[str, str], float]] = {
    "exact": lambda a, b: float(a == b),
    "normalized": lambda a, b: float(_plain(a) == _plain(b)),
    "jaro_winkler": lambda a, b: jaro_winkler_of(_plain(a), _plain(b)),
    "token_jaccard": _tokens_jaccard,
    "possessive_aware": possessive_aware_of,
}


def bits(ruleset: Ruleset, a: dict, b: dict) -> float:
    total = 0.0
    for r in ruleset.rules:
        x, y = a.get(r.field), b.get(r.field)
        if x is not None and y is not None:
            s = COMPARE[r.kind](x, y)
            total += s * r.agreement + (1 - s) * r.disagreement
    return total


def fold(ruleset: Ruleset, mentions: list[tuple[int, dict, list[str]]], rejected: set | None = None, known: list[tuple[int, dict, list[str]]] = ()) -> tuple[list[tuple[int, int, str, list[tuple[int, float]]]], dict[int, dict]]:
    """((mention, entity, outcome, reviews) in order, identity of each entity). An entity that was known before has its id as (id, record, keys); one created here is named -1 - mention."""
    held: dict[int, dict] = {}
    blocks: dict[str, set[int]] = {}
    for e, record, keys in known:
        held[e] = dict(record)
        for k in keys:
            blocks.setdefault(k, set()).add(e)
    old = {e for e, _, _ in known}
    age = lambda e: (e not in old, e if e in old else -e)  # noqa: E731 - known ones are older than created ones
    out = []
    for at, record, keys in mentions:
        near = sorted({e for k in keys for e in blocks.get(k, ())}, key=age)
        best, best_bits, doubts = None, None, []
        for e in near:
            s = bits(ruleset, record, held[e])
            if s >= ruleset.match_at:
                if best is None or s > best_bits:
                    best, best_bits = e, s
            elif s >= ruleset.review_at and not (rejected and frozenset((_key(record), _key(held[e]))) in rejected):
                doubts.append((e, s))
        entity = -1 - at if best is None else best
        for f, v in record.items():
            held.setdefault(entity, {}).setdefault(f, v)
        held.setdefault(entity, {})
        for k in keys:
            blocks.setdefault(k, set()).add(entity)
        out.append((at, entity, "merged" if best is not None else "created_pending_review" if doubts else "created", doubts if best is None else []))
    return out, held


def fold_equal(ruleset: Ruleset, given: list[tuple[dict, list[str], np.ndarray]], rejected: set | None = None, known: list[tuple[int, dict, list[str]]] = ()) -> tuple[list[list[tuple[int, int, str, list[tuple[int, float]]]]], dict[int, dict]]:
    """fold for mentions given as distinct records with their keys and their ids in order: (for each record, (from, entity, outcome, reviews) in order, identity of each entity).

    What is told from an id on holds for the record's mentions up to the next told; a
    creation is its first mention's alone. A mention that changes nothing is not
    looked at: a record is met again only at its first mention after an entity that
    it shares a key with was created, took a key or took a field. Each record and
    entity that share a key are compared once, and once more when the entity takes a field.
    """
    held = {e: dict(record) for e, record, _ in known}
    old, has = set(held), {}
    age = lambda e: (e not in old, e if e in old else -e)  # noqa: E731 - known ones are older than created ones
    near: dict[str, list[int]] = {}
    for r, (_, keys, _) in enumerate(given):
        for k in keys:
            near.setdefault(k, []).append(r)
    # what is below the review threshold need not be kept
    links: list[dict[int, float]] = [{} for _ in given]
    best: list[tuple[float, int] | None] = [None] * len(given)
    told: list[list] = [[] for _ in given]
    waits = [True] * len(given)
    queue = [(int(ids[0]), r) for r, (_, _, ids) in enumerate(given)]
    heapify(queue)

    def meet(e: int, rs, touched: set) -> None:
        for r in rs:
            s = bits(ruleset, given[r][0], held[e])
            if s >= ruleset.review_at:
                links[r][e] = s
            if s >= ruleset.match_at and (best[r] is None or s > best[r][0] or s == best[r][0] and age(e) < age(best[r][1])):
                best[r] = (s, e)
                touched.add(r)

    def again(e: int, touched: set) -> None:
        for r in {r for k in has[e] for r in near.get(k, ())}:
            links[r].pop(e, None)
            s, was = bits(ruleset, given[r][0], held[e]), best[r]
            if s >= ruleset.review_at:
                links[r][e] = s
            fit = [(x, f) for f, x in links[r].items() if x >= ruleset.match_at]
            best[r] = min(fit, key=lambda p: (-p[0], age(p[1]))) if fit else None
            if best[r] != was:
                touched.add(r)

    for e, _, keys in known:
        has[e] = set(keys)
        meet(e, {r for k in keys for r in near.get(k, ())}, set())
    while queue:
        at, r = heappop(queue)
        waits[r] = False
        record, keys, _ = given[r]
        touched: set[int] = set()
        if best[r] is None:
            doubts = sorted((p for p in links[r].items() if not (rejected and frozenset((_key(record), _key(held[p[0]]))) in rejected)), key=lambda p: age(p[0]))
            entity = -1 - at
            held[entity], has[entity] = dict(record), set()
            told[r].append((at, entity, "created_pending_review" if doubts else "created", doubts))
            touched.add(r)
        else:
            entity = best[r][1]
            told[r].append((at, entity, "merged", []))
            if any(f not in held[entity] for f in record):
                for f, v in record.items():
                    held[entity].setdefault(f, v)
                again(entity, touched)
        fresh = set(keys) - has[entity]
        known_to = {x for k in has[entity] for x in near.get(k, ())} if fresh and has[entity] else set()
        has[entity] |= fresh
        meet(entity, {x for k in fresh for x in near[k]} - known_to, touched)
        for x in touched:
            if told[x] and not waits[x]:
                i = int(np.searchsorted(given[x][2], at, "right"))
                if i < len(given[x][2]):
                    heappush(queue, (int(given[x][2][i]), x))
                    waits[x] = True
    return told, held


def _key(record: dict) -> tuple:
    return tuple(sorted(record.items()))


#: Rows that a task hands back at a time.
BATCH = 1 << 14


@dataclass
class Remembered:
    """told (mention, entity, outcome), reviews (review, a, b, score) that were filed, and identity (entity, record) of all entities."""

    told: DataFrame
    reviews: DataFrame
    identity: DataFrame


def remember_into(mentions: DataFrame, ruleset: Ruleset, identity: DataFrame | None = None, rejected: DataFrame | None = None, next_entity: int | None = None, next_review: int = 1) -> Remembered:
    """Mentions (id, record), in the order of their ids, met with the entities known before (identity: entity, record) and the pairs answered as different (rejected: a, b).

    New entities get the next ids in the order of the mentions that create them, reviews
    theirs by mention and then by the other entity. Two batches give what one gives.
    """
    spark = mentions.sparkSession
    identity = spark.createDataFrame([], "entity long, record map<string,string>") if identity is None else identity
    if next_entity is None:
        top = identity.agg(F.max("entity")).first()[0]
        next_entity = 1 if top is None else top + 1
    # equal mentions are one node; a node is such mentions (even) or a known entity (odd)
    old = identity.select((F.col("entity") * 2 + 1).alias("node"), F.col("entity").alias("id"), "record", all_keys(ruleset.blocking).alias("keys"), F.array().cast("array<long>").alias("ids"))
    new = bundles(mentions.select("id", "record"), ruleset.blocking, COUNTED).select((F.col("uid") * 2).alias("node"), F.lit(None).cast("long").alias("id"), "record", "keys", "ids")
    both = cut(new.unionByName(old))
    keys = both.select("node", F.explode("keys").alias("key"))
    star = keys.join(keys.groupBy("key").agg(F.min("node").alias("dst")), "key").select(F.col("node").alias("src"), "dst").where("src <> dst")
    groups = connected_components(star, cut).withColumnRenamed("component", "group")
    dealt = both.join(groups, "node", "left").select(F.coalesce("group", "node").alias("group"), "id", "record", "keys", "ids", F.lit(None).cast("map<string,string>").alias("other"))
    # a rejected pair is known by its records, which stand in one group
    if rejected is not None:
        named = lambda c: identity.select(F.col("entity").alias(c), F.col("record").alias(f"r{c}"))
        pairs = rejected.join(named("a"), "a").join(named("b"), "b").withColumn("node", F.col("a") * 2 + 1).join(groups, "node")
        dealt = dealt.unionByName(pairs.select("group", F.lit(None).cast("long").alias("id"), F.col("ra").alias("record"), F.lit(None).cast("array<string>").alias("keys"), F.lit(None).cast("array<long>").alias("ids"), F.col("rb").alias("other")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refused, known, asked = set(), [], {}
        for b in batches:
            ids = b.column("ids")
            for i, r in enumerate(b.select(["id", "record", "keys", "other"]).to_pylist(maps_as_pydicts="strict")):
                if r["other"] is not None:
                    refused.add(frozenset((_key(r["record"]), _key(r["other"]))))
                elif r["id"] is not None:
                    known.append((r["id"], r["record"], r["keys"]))
                else:
                    asked.setdefault(_key(r["record"]), (r["record"], r["keys"], []))[2].append(np.array(ids[i].values))
        given = [(r, k, np.sort(np.concatenate(n))) for r, k, n in asked.values()]
        told, held = fold_equal(ruleset, given, refused, sorted(known))
        for (_, _, ids), parts in zip(given, told, strict=True):
            ends = [*np.searchsorted(ids, [p[0] for p in parts]), len(ids)]
            one = [p for p in parts if p[2] != "merged"]
            if one:
                yield pa.RecordBatch.from_pylist([{"mention": m, "entity": e, "outcome": o, "others": [x for x, _ in d], "scores": [x for _, x in d]} for m, e, o, d in one], schema)
            for (_, e, o, _), low, high in zip(parts, ends[:-1], ends[1:], strict=True):
                for at in range(low, high if o == "merged" else low, BATCH):
                    m = ids[at : min(at + BATCH, high)]
                    yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(np.full(len(m), e), pa.int64()), pa.array([o] * len(m)), *[pa.nulls(len(m), schema.field(c).type) for c in ("others", "scores", "record")]], schema=schema)
        for low in range(0, len(names := list(held)), BATCH):
            yield pa.RecordBatch.from_pylist([{"entity": e, "record": json.dumps(held[e])} for e in names[low : low + BATCH]], schema)

    schema = pa.schema([("mention", pa.int64()), ("entity", pa.int64()), ("outcome", pa.string()), ("others", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())), ("record", pa.string())])
    done = cut(dealt.groupBy("group").applyInArrow(run, "mention long, entity long, outcome string, others array<long>, scores array<double>, record string"))
    made = number(done.where("outcome in ('created', 'created_pending_review')").select("mention"), ["mention"], "id", next_entity)
    ids = cut(made.select((-1 - F.col("mention")).alias("entity"), F.col("id").alias("final")))

    def final(df: DataFrame, column: str) -> DataFrame:
        return df.join(ids.select(F.col("entity").alias(column), "final"), column, "left").withColumn(column, F.coalesce("final", column)).drop("final")

    told = done.where("mention is not null")
    filed = told.select("mention", "entity", F.explode(F.arrays_zip("others", "scores")).alias("o")).select("mention", F.col("entity").alias("own"), F.col("o.others").alias("other"), F.col("o.scores").alias("score"))
    filed = number(final(final(filed, "own"), "other"), ["mention", "other"], "review", next_review)
    reviews = filed.select("review", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "score")
    known = final(done.where("record is not null").select("entity", F.from_json("record", "map<string,string>").alias("record")), "entity")
    return Remembered(final(told.select("mention", "entity", "outcome"), "entity").select("mention", "entity", "outcome"), reviews, known.select("entity", "record"))


def remember(mentions: DataFrame, ruleset: Ruleset) -> tuple[DataFrame, DataFrame]:
    """((mention, entity, outcome), (review, a, b, score)) of mentions (id, record), met with no entities known before."""
    got = remember_into(mentions, ruleset)
    return got.told, got.reviews
