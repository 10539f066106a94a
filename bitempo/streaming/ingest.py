"""Turns to rows of memory: extraction, identity, then facts, relations and closures; as a batch or per micro-batch."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.operators import mutations, vector
from bitempo.operators.extract import extract
from bitempo.operators.memory import SCHEMAS, Memory, _next
from bitempo.operators.remember import remember_into
from bitempo.operators.resolve import Blocking, Rule, Ruleset
from bitempo.plans.loops import cut
from bitempo.plans.numbering import number
from bitempo.schema import LOG, TRIPLE

#: The shipped rules for mentions.
RULES = Ruleset((Rule("name", "possessive_aware", 0.9, 0.01), Rule("kind", "exact", 0.9, 0.38)), (Blocking("prefix", "name", 3),), 5.2439, 7.2439)


@dataclass
class Ingested:
    """What the turns add, and the memory after them."""

    versions: DataFrame
    edges: DataFrame
    reviews: DataFrame
    dropped: DataFrame
    told: DataFrame
    memory: Memory


def ingest(turns: DataFrame, completer: Callable[[str, str | None], str], ruleset: Ruleset = RULES, memory: Memory | None = None, embedder: Callable[[str], list[float]] | None = None) -> Ingested:
    """Rows written by the turns, in their order (observed_at, session, position), behind those of a memory.

    What a turn states is from a tool at the instant it was observed; a closure is an
    inference, spares what its own turn asserts, and ends the edges in force at its
    instant among all that the memory and the turns before hold. With an embedder,
    mentions and facts are stored with the vector of their text, or the whole batch is
    refused before anything is written. Two batches give what one gives, if the turns of
    the first come before those of the second.
    """
    spark = turns.sparkSession
    memory = Memory.empty(spark) if memory is None else memory
    items = cut(extract(turns, completer))
    observed = turns.select("session", "position", "observed_at")
    ok = items.where("why is null").join(observed, ["session", "position"])
    mentions = cut(number(ok.where("section = 'mentions'"), ORDER, "id"))
    records = mentions.select("id", F.create_map(F.lit("name"), F.col("name"), F.lit("kind"), F.col("kind")).alias("record"))
    next_entity = _next(memory.entities, "entity")
    got = remember_into(records, ruleset, memory.identity, memory.rejected, next_entity, _next(memory.reviews, "review"))
    told = cut(mentions.join(got.told, F.col("id") == F.col("mention")).select("session", "position", "item", "entity", "kind", "name", "text", "outcome", "observed_at"))
    at = lambda c, name: told.select("session", "position", F.col("item").alias(c), F.col("entity").alias(name))
    created = told.where("outcome <> 'merged'").select("entity", "kind", F.col("observed_at").alias("created_at"))
    kinds = told.select("entity", F.lit("kind").alias("attribute"), F.col("kind").alias("value"), "text", F.col("observed_at").alias("valid_from"), "observed_at", "session", "position", F.lit(0).alias("section"), "item")
    facts = ok.where("section = 'facts'").join(at("subject", "entity"), ["session", "position", "subject"]).select("entity", "attribute", "value", "text", F.col("at").alias("valid_from"), "observed_at", "session", "position", F.lit(1).alias("section"), "item")
    rows = kinds.unionByName(facts).select("*", F.when(F.col("value").isNull(), "absent").otherwise("value").alias("state"), F.lit(None).cast("long").alias("valid_to"), F.col("observed_at").alias("tx"), F.lit("tool_output").alias("source"))
    rows = number(rows, ["observed_at", "session", "position", "section", "item"], "assertion_id", max(_next(memory.vectors, "assertion_id"), _next(memory.versions, "assertion_id")))
    rows = cut(rows.withColumn("session", F.col("session").cast("string")))
    vectors = memory.vectors
    if embedder is not None:
        vectors = vectors.unionByName(embedded(rows.select("assertion_id", "text"), embedder, memory.dim, memory.metric))
    fresh = rows.withColumn("seq", F.col("assertion_id"))
    versions = mutations.append(memory.versions, fresh if embedder is not None else fresh.withColumn("assertion_id", F.lit(None).cast("long")), LOG)
    edges = cut(related(ok, at, memory.edges))
    after = Memory(memory.entities.unionByName(created), versions, edges, got.identity, vectors, memory.reviews.unionByName(got.reviews), memory.rejected, memory.dim, memory.metric)
    return Ingested(versions, edges, got.reviews, items.where("why is not null"), told, after)


ORDER = ["observed_at", "session", "position", "item"]


def embedded(rows: DataFrame, embedder: Callable[[str], list[float]], dim: int, metric: str) -> DataFrame:
    """(assertion_id, vector) of rows (assertion_id, text); each is checked, and one that cannot be stored refuses them all."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"assertion_id": pdf["assertion_id"], "vector": [list(map(float, embedder(t or ""))) for t in pdf["text"]]})

    out = cut(rows.mapInPandas(run, "assertion_id long, vector array<double>"))
    bad = out.withColumn("why", vector.problems("vector", dim, metric)).where("why is not null").select("why").first()
    if bad:
        raise ValueError(bad["why"])
    return vector.prepare(out, dim, metric)


#: Tasks over which the triples of one subject and predicate are dealt.
SHARES = 16


def related(ok: DataFrame, at: Callable, known: DataFrame) -> DataFrame:
    """known edge versions with those of the items' relations, and the tombstones of their closures.

    A closure meets every triple of its subject and predicate; what holds of a triple
    depends on that triple's own versions and closures in order, so triples are folded
    apart, some of them in a task, where a closure that ends nothing costs nothing.
    """
    place = F.struct("observed_at", "session", "position")
    rel = ok.where("section = 'relations'").join(at("subject", "s"), ["session", "position", "subject"]).join(at("object", "o"), ["session", "position", "object"]).where("s <> o")
    stated = rel.select(F.col("s").alias("subject"), "predicate", F.col("o").alias("object"), place.alias("turn"), F.lit(1).alias("step"), F.col("item").cast("long").alias("nth"), F.lit(True).alias("present"), F.col("at").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.col("observed_at").alias("tx"), F.lit("tool_output").alias("source"), F.col("session").cast("string").alias("session"), F.lit(None).cast("string").alias("because"))
    closures = ok.where("section = 'closures'").join(at("subject", "s"), ["session", "position", "subject"]).select(F.col("s").alias("subject"), "predicate", place.alias("turn"), F.lit(2).alias("step"), F.col("item").cast("long").alias("nth"), F.col("at").alias("valid_from"), F.col("observed_at").alias("tx"), F.col("session").cast("string").alias("session"), F.col("text").alias("because"))
    old = known.select(*TRIPLE, F.lit(None).cast(stated.schema["turn"].dataType).alias("turn"), F.lit(0).alias("step"), F.col("seq").alias("nth"), "present", "valid_from", "valid_to", "tx", "source", "session", "because")
    # closures go to the shares of their subject and predicate's triples, not to each triple
    share = F.pmod(F.xxhash64("object"), F.lit(SHARES)).alias("share")
    rows = old.unionByName(stated).select("*", share)
    there = rows.select("subject", "predicate", "share").distinct()
    ends = closures.join(there, ["subject", "predicate"]).select("subject", "predicate", F.lit(None).cast("long").alias("object"), "turn", "step", "nth", F.lit(None).cast("boolean").alias("present"), "valid_from", F.lit(None).cast("long").alias("valid_to"), "tx", F.lit("agent_inference").alias("source"), "session", "because", "share")
    rows = rows.unionByName(ends)
    rows = rows.select(*[c for c in rows.columns if c != "turn"], *[F.col(f"turn.{c}").alias(f"turn_{c}") for c in ("observed_at", "session", "position")])

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [*[(f"turn_{c}", "ascending") for c in ("observed_at", "session", "position")], ("step", "ascending"), ("nth", "ascending")], null_placement="at_start"))
        at, kept, cut_ = folded(t)
        out = t.take(pa.array(kept, pa.int64()))
        ends = np.zeros(len(kept), bool)
        ends[cut_[0]] = True
        present = pc.if_else(pa.array(ends), False, out["present"])
        objects = np.asarray(out["object"].fill_null(0)).copy()
        objects[cut_[0]] = cut_[1]
        done = {c: out[c] for c in schema.names if c in out.column_names} | {"present": present, "object": pa.array(objects, pa.int64()), "seq": pa.array(at, pa.int64())}
        return pa.table([done[c] for c in schema.names], schema=schema)

    long, text = pa.int64(), pa.string()
    schema = pa.schema([("subject", long), ("predicate", text), ("object", long), ("seq", long), ("present", pa.bool_()), ("valid_from", long), ("valid_to", long), ("tx", long), ("source", text), ("session", text), ("because", text)])
    return rows.groupBy("subject", "predicate", "share").applyInArrow(run, SCHEMAS["edges"])


def folded(t: pa.Table) -> tuple[list[int], list[int], tuple[list[int], list[int]]]:
    """(seq, row) of each edge version of some triples of one subject and predicate, and (which of these are tombstones, their object); t: known versions (without a turn), relations and closures (without an object), in order."""
    step = np.asarray(t["step"])
    long = lambda c: np.asarray(t[c].fill_null(0))
    objects, vf, tx, vt, present = long("object"), long("valid_from"), long("tx"), t["valid_to"].to_pylist() if t["valid_to"].null_count < len(t) else None, np.asarray(t["present"].fill_null(False))
    turns = [t[f"turn_{c}"].combine_chunks() for c in ("observed_at", "session", "position")]
    new = np.zeros(len(t), bool)
    for c in turns:
        # rows without a turn come first and are never compared with others
        new[1:] |= np.asarray(pc.fill_null(pc.not_equal(c[1:], c[:-1]), True))
    turn = np.cumsum(new)
    closing = np.flatnonzero(step == 2)
    cv, ct = vf[closing], turn[closing]
    # the least valid instant of a closure and all behind it
    least = np.minimum.accumulate(cv[::-1])[::-1] if len(cv) else cv
    own = np.flatnonzero(step < 2)
    own = own[np.argsort(objects[own], kind="stable")]
    starts = np.flatnonzero(np.r_[True, np.diff(objects[own]) != 0]) if len(own) else []
    seqs: list[int] = []
    kept: list[int] = []
    tombs: list[int] = []
    ended: list[int] = []
    for low, high in zip(starts, [*starts[1:], len(own)], strict=True):
        events = own[low:high]
        first = len(kept)
        # closures of the turn that asserts spare the triple; known versions come before all closures
        gaps = [int(np.searchsorted(ct, turn[e], "right")) if step[e] == 1 else 0 for e in events]
        plain = (vt is None or all(vt[e] is None for e in events)) and bool(np.all(np.diff(tx[events]) >= 0)) and (step[events[-1]] == 1 or not len(closing) or tx[events[-1]] <= tx[closing[0]]) and not any(step[e] == 0 and len(closing) and tx[e] > tx[closing[0]] for e in events)
        bv: list[int] = []
        bs: list[bool] = []

        def add(e: int, obj: int | None = None) -> None:
            if obj is not None:
                tombs.append(len(kept))
                ended.append(obj)
            seqs.append(len(kept) - first)
            kept.append(int(e))
            # a version learned last holds from its instant on, whatever stood there
            while bv and bv[-1] >= vf[e]:
                bv.pop(), bs.pop()
            holds = bool(present[e])
            if not bs or bs[-1] != holds:
                bv.append(int(vf[e])), bs.append(holds)

        def live(v: int) -> bool:
            if plain:
                k = bisect_right(bv, v) - 1
                return k >= 0 and bs[k]
            held = [(tx[e], i) for i, e in enumerate(kept[first:]) if vf[e] <= v and (vt is None or vt[e] is None or v < vt[e])]
            return bool(held) and bool(present[kept[first + max(held)[1]]])

        for n, e in enumerate(events):
            add(e)
            if n + 1 < len(events) and step[events[n + 1]] == 0:
                continue
            i, j = gaps[n], int(np.searchsorted(closing, events[n + 1])) if n + 1 < len(events) else len(closing)
            size = 16
            while i < j:
                if plain and not bs[-1] and least[i] >= bv[-1]:
                    break
                part = cv[i : min(i + size, j)]
                some = np.flatnonzero(part < bv[-1]) if plain and not bs[-1] else range(len(part))
                hit = next((k for k in some if live(int(part[k]))), None)
                if hit is None:
                    i, size = i + len(part), size * 4
                else:
                    add(int(closing[i + hit]), int(objects[e]))
                    i, size = i + hit + 1, 16
    return seqs, kept, (tombs, ended)


def start(turns: DataFrame, completer: Callable[[str, str | None], str], commit: Callable[[Ingested, int], None], done: Callable[[SparkSession], set[int]], checkpoint: str, ruleset: Ruleset = RULES, memory: Callable[[SparkSession], Memory | None] | None = None):
    """A streaming query that ingests each micro-batch once, behind what the memory holds by then: batches that the commit log names already are skipped."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number not in done(spark):
            commit(ingest(batch, completer, ruleset, memory(spark) if memory else None), number)

    return turns.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
