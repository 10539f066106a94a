"""Extraction responses to rows, keeping every item that is well formed and naming each that is not."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.plans.loops import cut
from bitempo.schema import DAY_MS

#: The kinds a mention may have.
KINDS = ("person", "organisation", "place", "event", "work", "animal", "thing")
SECTIONS = ("mentions", "facts", "relations", "closures")
ROWS = "session long, position long, section string, item int, subject int, object int, kind string, name string, attribute string, predicate string, value string, text string, at long, why string"
LIMIT = (1 << 63) - 1


class Unparsable(ValueError):
    """A response that is no JSON object of lists."""


def prompt(speaker: str | None, text: str) -> str:
    """What is asked of a completer about a turn."""
    who = f"The speaker is {speaker}." if speaker else "The speaker is not known."
    return f"Answer with one JSON object with the lists mentions, facts, relations and closures. A mention has kind (one of {', '.join(KINDS)}), name and text. {who}\n\n{text}"


def prompted(model: Callable[[str], str]) -> Callable[[str, str | None], str]:
    """A completer of turns from a model that answers prompts."""
    return lambda text, speaker: model(prompt(speaker, text))


def resolve_days(days, observed_at: int) -> int | None:
    """The instant some days ago; none where the number is negative."""
    if days is None:
        return observed_at
    return None if days < 0 else max(-LIMIT - 1, observed_at - days * DAY_MS)


def days_ago(days, observed_at):
    """resolve_days as a column: decimals keep the product from overflowing."""
    far = observed_at.cast("decimal(38,0)") - days.cast("decimal(38,0)") * DAY_MS
    return F.when(days.isNull(), observed_at).when(days >= 0, F.greatest(far, F.lit(-LIMIT - 1).cast("decimal(38,0)")).cast("long"))


def _no_number(name: str):
    raise ValueError(f"{name} is not JSON")


def _is(kind, x) -> bool:
    return isinstance(x, kind) and not isinstance(x, bool)


def salvage(response: str, observed_at: int) -> list[dict]:
    """A row for each item: its fields, or why it was dropped. Mentions keep their positions."""
    try:
        whole = json.loads(response, parse_constant=_no_number)
    except ValueError as e:
        raise Unparsable(str(e)) from e
    if not isinstance(whole, dict) or any(not isinstance(whole.get(s, []), list) for s in SECTIONS):
        raise Unparsable("not an object of lists")
    out, good = [], set()

    def fail(x: dict) -> str | None:
        wrong = [f for f in ("kind", "name", "text") if not _is(str, x.get(f))]
        return f"{wrong[0]} is not a string" if wrong else None if x["name"].strip() else "a mention without a name"

    for i, x in enumerate(whole.get("mentions", [])):
        why = fail(x) if isinstance(x, dict) else "not an object"
        if why is None:
            good.add(i)
        out.append({"section": "mentions", "item": i, "why": why} | ({k: x[k] for k in ("kind", "name", "text")} if why is None else {}))

    def anchored(x: dict, field: str) -> str | None:
        v = x.get(field)
        return f"{field} is not a whole number" if not _is(int, v) else f"{field} names no mention" if v not in good else None

    def dated(x: dict) -> str | None:
        d = x.get("days_ago")
        return "days_ago is not a whole number" if d is not None and (not _is(int, d) or not -LIMIT - 1 <= d <= LIMIT) else "days_ago is negative" if d is not None and d < 0 else None

    def text_of(x: dict, *fields: str) -> str | None:
        bad = [f for f in fields if not _is(str, x.get(f))]
        return f"{bad[0]} is not a string" if bad else None

    for i, x in enumerate(whole.get("facts", [])):
        why = "not an object"
        if isinstance(x, dict):
            why = text_of(x, "attribute", "text") or (None if x.get("value") is None or _is(str, x["value"]) else "value is not a string") or anchored(x, "subject") or dated(x)
        out.append({"section": "facts", "item": i, "why": why} | ({"subject": x["subject"], "attribute": x["attribute"], "value": x.get("value"), "text": x["text"], "at": resolve_days(x.get("days_ago"), observed_at)} if why is None else {}))
    for i, x in enumerate(whole.get("relations", [])):
        why = "not an object"
        if isinstance(x, dict):
            same = _is(int, x.get("subject")) and x.get("subject") == x.get("object")
            why = text_of(x, "predicate") or ("an edge to itself" if same else None) or anchored(x, "subject") or anchored(x, "object") or dated(x)
        out.append({"section": "relations", "item": i, "why": why} | ({"subject": x["subject"], "object": x["object"], "predicate": x["predicate"], "at": resolve_days(x.get("days_ago"), observed_at)} if why is None else {}))
    for i, x in enumerate(whole.get("closures", [])):
        why = "not an object"
        if isinstance(x, dict):
            why = text_of(x, "predicate", "because") or anchored(x, "subject") or dated(x)
        out.append({"section": "closures", "item": i, "why": why} | ({"subject": x["subject"], "predicate": x["predicate"], "text": x["because"], "at": resolve_days(x.get("days_ago"), observed_at)} if why is None else {}))
    return out


def extract(turns: DataFrame, completer: Callable[[str, str | None], str], observed_at: str = "observed_at") -> DataFrame:
    """Item rows of turns (session, position, speaker, text, observed_at); an unparsable response is one row of section 'response'. completer is called on the executors."""
    columns = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                try:
                    items = salvage(completer(t.text or "", t.speaker), int(t.observed_at))
                except Unparsable:
                    items = [{"section": "response", "item": 0, "why": "unparsable"}]
                rows += [{"session": t.session, "position": t.position} | x for x in items]
            out = pd.DataFrame(rows, columns=columns, dtype=object)
            out = out.where(out.notna(), None)
            for c in ("subject", "object"):
                out[c] = out[c].astype("Int32")
            out["at"] = out["at"].astype("Int64")
            yield out

    # a response may hold any number of items: a batch of turns is small
    return turns.select("session", "position", "speaker", "text", F.col(observed_at).alias("observed_at")).mapInPandas(run, ROWS.replace("session long", f"session {dict(turns.dtypes)['session']}"))


def stub_completer(text: str, speaker: str | None) -> str:
    """A stand-in for a model, the same for the same turn: some of its items are malformed, some responses are prose."""
    words = text.split()
    n = len(words)
    if n % 11 == 0:
        return "I found nothing."
    mentions = [{"kind": "person", "name": speaker or "someone", "text": text[:40]}, {"kind": "thing", "name": words[0] if words else "", "text": text[:40]}]
    facts = [{"subject": 0, "attribute": "said", "value": words[-1] if n % 3 else None, "text": text[:40], "days_ago": n % 5 or None}, {"subject": 7, "attribute": "lost", "value": "x", "text": "x"}, {"subject": 1, "attribute": "flag", "value": True, "text": "x"}]
    relations = [{"subject": 0, "predicate": "spoke_of", "object": 1, "days_ago": -1 if n % 7 == 0 else 0}, {"subject": 1, "predicate": "is", "object": 1}]
    closures = [{"subject": 0, "predicate": "spoke_of", "because": "over", "days_ago": 0}] if n % 4 == 0 else []
    return json.dumps({"mentions": mentions, "facts": facts, "relations": relations, "closures": closures})


def responses(turns: DataFrame, completer: Callable[[str, str | None], str], cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns with their response, the cache (asked, response) with what was new): each prompt is completed once, and not at all if the cache has it."""
    told = turns.withColumn("asked", F.sha2(F.concat_ws("\x00", F.coalesce("speaker", F.lit("\x01")), "text"), 256))
    fresh = told.select("asked", "speaker", "text").dropDuplicates(["asked"])
    fresh = fresh if cache is None else fresh.join(cache.select("asked"), "asked", "left_anti")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"asked": pdf["asked"], "response": [completer(t or "", s) for t, s in zip(pdf["text"], pdf["speaker"], strict=True)]})

    new = cut(fresh.mapInPandas(run, "asked string, response string"))
    known = new if cache is None else cache.select("asked", "response").unionByName(new)
    return told.join(known, "asked", "left"), known


def extract_responses(answered: DataFrame, observed_at: str = "observed_at") -> DataFrame:
    """Item rows, as extract gives them, of turns that carry their response."""
    given = answered.select("session", "position", F.lit(None).cast("string").alias("speaker"), F.col("response").alias("text"), observed_at)
    return extract(given, lambda text, _: text, observed_at)


def validate(items: DataFrame) -> DataFrame:
    """(session, position, section, item, why) of what makes a whole extraction invalid: given items (as extract's rows, unchecked) with a nameless mention, an index that names no mention, or an edge to itself. A turn without rows here may be written."""
    size = items.where("section = 'mentions'").groupBy("session", "position").agg((F.max("item") + 1).alias("mentions"))
    held = items.join(size, ["session", "position"], "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    out = lambda c: F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) >= F.col("mentions"))
    mention, edge = F.col("section") == "mentions", F.col("section") == "relations"
    why = F.when(mention & (F.coalesce(F.trim("name"), F.lit("")) == ""), "a mention without a name").when(~mention & out("subject"), "subject names no mention").when(edge & out("object"), "object names no mention").when(edge & (F.col("subject") == F.col("object")), "an edge to itself")
    return held.select("session", "position", "section", "item", why.alias("why")).where("why is not null")
