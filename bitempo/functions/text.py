"""Comparators of entity resolution. Native columns where they can be; Arrow UDFs for the Jaro family."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The determiners that may stand before a possessed head.
DETERMINERS = ("my", "your", "his", "her", "its", "our", "their")


def normalize(c: Column) -> Column:
    """Letters, digits and single blanks, in lower case; accents stay. Lower-cased letter by letter."""
    kept = F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]+", "")
    one = F.trim(F.regexp_replace(kept, r"\p{IsWhite_Space}+", " "))
    return F.array_join(F.transform(F.split(one, ""), lambda x: F.lower(x)), "")


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(normalize(c), " "), "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens of the left side, counted as often as they stand there, over all distinct ones counted by both lists: the value can exceed 1 where tokens repeat."""
    return _tokens_jaccard(tokens(a), tokens(b))


def _tokens_jaccard(ta: Column, tb: Column) -> Column:
    both = F.size(F.filter(ta, lambda t: F.array_contains(tb, t)))
    rest = F.size(ta) + F.size(tb) - both
    return F.when(ta.isNull() | tb.isNull(), F.lit(None).cast("double")).when(F.size(ta) + F.size(tb) == 0, 1.0).when(rest == 0, F.lit(0.0)).otherwise(both / rest)


def jaro_of(a: str, b: str) -> float:
    if not a or not b:
        return float(not a and not b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    base = jaro_of(a, b)
    if base < 0.7:
        return base
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return base + p * 0.1 * (1 - base)


#: An apostrophe, straight or curly, that ends a word with something behind it.
OWNS = regex.compile(r"(?<=.)['\u2019]s?\p{White_Space}+", regex.S)
STRANGE = regex.compile(r"[^\p{Alphabetic}\p{N}\p{White_Space}]+")
BLANKS = regex.compile(r"\p{White_Space}+")


def possessive_parts_of(text: str) -> tuple[str | None, str]:
    """(owner, head) of a possessive phrase; without one (None, the whole). The first apostrophe that ends a word parts them, or a determiner in front."""
    whole = regex.sub(r"^\p{White_Space}+|\p{White_Space}+$", "", text)
    m = OWNS.search(whole)
    if m:
        return whole[: m.start()], whole[m.end() :]
    m = BLANKS.search(whole)
    if m and _plain(whole[: m.start()]) in DETERMINERS:
        return whole[: m.start()], whole[m.end() :]
    return None, whole


def _plain(text: str) -> str:
    """What normalize gives, for one string: letters by the Alphabetic property."""
    return "".join(c.lower() for c in BLANKS.sub(" ", STRANGE.sub("", text)).strip(" "))


def possessive_aware_of(a: str, b: str) -> float:
    """The worse of owners compared and heads compared; possession on one side alone is 0."""
    (oa, ha), (ob, hb) = possessive_parts_of(a), possessive_parts_of(b)
    if (oa is None) != (ob is None):
        return 0.0
    heads = jaro_winkler_of(_plain(ha), _plain(hb))
    return heads if oa is None else min(heads, jaro_winkler_of(_plain(oa), _plain(ob)))


def _pairwise(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        # a batch compares each pair of strings once
        known = {(x, y): None if x is None or y is None else f(x, y) for x, y in set(zip(a, b, strict=True))}
        return pd.Series([known[p] for p in zip(a, b, strict=True)], dtype="float64")

    return run


def jaro(a: Column, b: Column) -> Column:
    return _pairwise(jaro_of)(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _pairwise(jaro_winkler_of)(a, b)


def possessive_aware(a: Column, b: Column) -> Column:
    return _pairwise(possessive_aware_of)(a, b)


def ready_for(kind: str, c: Column) -> Column:
    """What compare_ready of that kind reads of a text."""
    return {"normalized": lambda: normalize(c), "jaro_winkler": lambda: normalize(c), "token_jaccard": lambda: tokens(c)}.get(kind, lambda: c)()


def compare_ready(kind: str, a: Column, b: Column) -> Column:
    """A comparator by name, of texts made ready for it: exact, normalized, jaro_winkler, token_jaccard or possessive_aware."""
    return {
        "exact": lambda: (a == b).cast("double"),
        "normalized": lambda: (a == b).cast("double"),
        "jaro_winkler": lambda: jaro_winkler(a, b),
        "token_jaccard": lambda: _tokens_jaccard(a, b),
        "possessive_aware": lambda: possessive_aware(a, b),
    }[kind]()


def compare(kind: str, a: Column, b: Column) -> Column:
    """A comparator by name."""
    return compare_ready(kind, ready_for(kind, a), ready_for(kind, b))


def possessive_parts(c: Column) -> Column:
    """struct(owner, head) of a phrase."""

    @F.pandas_udf("owner string, head string")
    def run(texts: pd.Series) -> pd.DataFrame:
        known = {t: (None, None) if t is None else possessive_parts_of(t) for t in set(texts)}
        return pd.DataFrame([known[t] for t in texts], columns=["owner", "head"])

    return run(c)
