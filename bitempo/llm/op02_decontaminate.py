"""Operator 2: benchmark decontamination with DataFrame functions only.

Words are runs of letters and digits in lower case. A document's windows are as long
as an item, and stand where one of the item's word grams occurs (a window without any
of an item's shingles has similarity 0 to it). Windows and items get 64-bit SimHash
fingerprints of their ``size``-word shingles, weighted by the square root of how often each occurs: then two
whose weighted Jaccard similarity is 0.8 have a cosine of 0.889 at least, however long
they are and however often one shingle repeats, which plain counts do not give.

A fingerprint within ``radius`` bits of another agrees with it up to
``radius // blocks`` bits in at least one of ``blocks`` equal parts (the pigeonhole
principle). So each item is listed, for each part, under every value that near, and a
window looks up its own parts under the items whose gram it was placed by: that finds
all of these within the radius, and what is joined grows with the hits, not with hits
times items. Candidates within the radius are verified by exact weighted Jaccard
similarity of their shingles.

Items shorter than a shingle are one shingle, and are looked for as such; a document
shorter than an item is one window. Items or documents without words, or null, match
nothing. A null id, of a document or an item, comes back as null, for benchmarks of any
size. Rows that repeat are reported once; of windows that are as similar the first is
named. Very long texts are read whole, as one row's arrays. Extra columns are ignored;
an empty table on either side gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.llm.spaces import free_name, shared_folder, through

BITS = 64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def grams(words: str, size: int) -> Column:
    """Hashes of the runs of `size` words in the array column of word hashes."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.transform(F.slice(words, F.lit(1), F.greatest(n, F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, size)]))).otherwise(F.array().cast("array<bigint>"))


def shingles(words: str, size: int) -> Column:
    """Shingles as strings, repeated ones repeated; with fewer words, the whole run as one."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(F.col(words), i, size)))
    return F.when(n > 0, many).otherwise(F.array().cast("array<string>"))


def votes(hashes: str) -> Column:
    """(h, w) of each distinct hash in the array column, weighted by the square root of how often it occurs."""
    one = F.array_distinct(hashes)
    counted = F.transform(one, lambda h: F.struct(h.alias("h"), F.round(F.sqrt(F.size(F.filter(F.col(hashes), lambda x: x == h))) * 1024).cast("bigint").alias("w")))
    return F.when(F.size(one) == F.size(hashes), F.transform(one, lambda h: F.struct(h.alias("h"), F.lit(1024).cast("bigint").alias("w")))).otherwise(counted)


def fingerprint(votes: str) -> Column:
    """SimHash of an array of weighted hashes: bit b is set where those that have it weigh more than the others."""

    def bit(b: Column) -> Column:
        sums = F.aggregate(F.col(votes), F.lit(0).cast("bigint"), lambda a, v: a + (F.call_function("getbit", v["h"], b).cast("bigint") * 2 - 1) * v["w"])
        return F.when(sums > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    # naming the votes twice keeps the optimizer from computing them anew for every bit
    return F.when(F.size(votes) > 0, F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(bit(b)))).otherwise(F.lit(0).cast("bigint"))


def part(value: Column, i: Column | int, blocks: int) -> Column:
    wide = BITS // blocks
    shift = (F.lit(i) if isinstance(i, int) else i) * wide
    return F.call_function("shiftrightunsigned", value, shift.cast("int")).bitwiseAND(F.lit((1 << wide) - 1).cast("bigint"))


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, weights being counts."""
    count = lambda c, x: F.size(F.filter(F.col(c), lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def near_parts(items: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(no, i, value, ...) for each part i of an item's fingerprint and each value that near."""
    wide = BITS // blocks
    masks = [sum(1 << b for b in bits) for k in range(radius // blocks + 1) for bits in combinations(range(wide), k)]
    listed = items.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("mask", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])))
    return listed.withColumn("value", part(F.col("print"), F.col("i"), blocks).bitwiseXOR(F.col("mask"))).drop("mask")


def item_table(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(item_id, n, item_words, item_shingles, print) of the items that have words."""
    out = benchmark.select(F.col(item).alias("item_id"), words_of(F.col(text)).alias("item_words")).where(F.size("item_words") > 0).dropDuplicates()
    out = out.withColumn("n", F.size("item_words")).withColumn("item_shingles", shingles("item_words", size))
    out = out.withColumn("hashes", F.transform("item_shingles", lambda s: F.xxhash64(s)))
    return out.withColumn("votes", votes("hashes")).withColumn("print", fingerprint("votes")).drop("hashes", "votes")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 5, least: float = 0.8, radius: int = 23, blocks: int = 8, literal_grams: int = 100_000, broadcast_rows: int = 500_000) -> DataFrame:
    """(key, item_id, start, similarity): each document's best window for each item that it contains."""
    folder = shared_folder(docs.sparkSession)
    # a window and an item each get a number where they are written: ids may be null or repeated
    items = through(item_table(benchmark, item, item_text, size).withColumn("k", F.least(F.lit(size), "n")).withColumn("no", F.monotonically_increasing_id()), f"{folder}/items")
    placed = items.withColumn("word_hashes", F.transform("item_words", lambda w: F.xxhash64(w)))
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())  # at most `size` values
    rows = docs.select(F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    if not sizes:
        return rows.select(F.col("key").alias(key), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity")).where("false")
    hashed = rows.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    windows, stable = [], None
    for k in sizes:
        spots = placed.where(F.col("k") == k).select("no", "n", F.posexplode(grams("word_hashes", k)).alias("offset", "gram"))
        known = spots.select("gram").distinct()
        some = [r[0] for r in known.limit(literal_grams + 1).collect()]
        few = spots.limit(broadcast_rows + 1).count() <= broadcast_rows
        every = hashed.select("key", "words", grams("word_hashes", k).alias("grams"))
        if len(some) <= literal_grams:  # a set within the scan's own expressions
            hits = every.withColumn("hits", F.filter(F.transform("grams", lambda g, i: F.when(g.isin(some), F.struct(i.alias("at"), g.alias("gram")))), lambda h: h.isNotNull()))
            # the filter names a column that must not be computed twice, so it stays above the arrays instead of repeating them
            kept = hits.withColumn("tick", F.monotonically_increasing_id()).where((F.size("hits") > 0) & (F.col("tick") >= 0))
            found = kept.select("key", "words", F.explode("hits").alias("hit")).select("key", "words", "hit.at", "hit.gram")
        else:
            if stable is None:
                stable = through(rows.withColumn("row", F.monotonically_increasing_id()), f"{folder}/rows")
            spread = stable.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w))).select("row", F.posexplode(grams("word_hashes", k)).alias("at", "gram"))
            found = spread.join(known, "gram").join(stable, "row").drop("row")
        found = found.join(F.broadcast(spots) if few else spots, "gram")
        start = F.col("at") - F.col("offset")
        found = found.withColumn("start", F.greatest(F.lit(0), F.least(start, F.size("words") - F.col("n"))))
        windows.append(found.select("key", "start", "n", "no", F.slice("words", F.col("start") + 1, F.col("n")).alias("window")))
    window = reduce(DataFrame.unionAll, windows).groupBy("key", "start", "n", "window").agg(F.collect_set("no").alias("nos"))
    window = window.withColumn("shingles", shingles("window", size)).withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(s))).withColumn("votes", votes("hashes"))
    # written, so that no filter above can be moved below the fingerprints and compute them for every hit
    window = through(window.select("key", "start", "nos", "shingles", fingerprint("votes").alias("own"), F.monotonically_increasing_id().alias("window")), f"{folder}/windows")
    parts = near_parts(items.select("no", "print"), radius, blocks)
    few = parts.limit(broadcast_rows + 1).count() <= broadcast_rows
    looked = window.select("window", F.explode("nos").alias("no"), "own").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("value", part(F.col("own"), F.col("i"), blocks))
    near = looked.join(F.broadcast(parts) if few else parts, ["no", "i", "value"]).where(F.bit_count(F.col("own").bitwiseXOR(F.col("print"))) <= radius)
    # a pair within the radius can meet in several parts
    met = near.select("window", "no").distinct()
    full = met.join(window.select("window", "key", "start", "shingles"), "window")
    pairs = full.join(items.select("no", "item_id", "item_shingles"), "no").withColumn("similarity", similarity("shingles", "item_shingles")).where(F.col("similarity") >= least)
    best = pairs.groupBy("key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select(F.col("key").alias(key), "item_id", (-F.col("best.back")).alias("start"), F.round("best.similarity", 9).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows whose own text contains no item, with all their columns. The text alone decides, and stands for itself by 128 bits of hashes; an id is a column like others."""
    digest = lambda name: F.struct(F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.col(text), F.lit(1)).alias("b")).alias(name)
    leaks = contaminated(docs.select(digest("leak"), text), benchmark, "leak", text, **options).select("leak").distinct()
    own = free_name(docs, "own")
    leaks = leaks.select(F.col("leak").alias(own))
    return docs.withColumn(own, digest(own)).join(leaks, own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
