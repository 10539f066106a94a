"""Nulls, empty texts, repeated rows, clashing extra columns and empty tables for each operator and stage."""

import hashlib
import os

import public_tokenizers
import pytest

import corpus_pipeline
from bitempo.llm.op01_bpe import bpe_decode, bpe_encode, bpe_round_trip
from bitempo.llm.op02_decontaminate import contaminated, decontaminate
from bitempo.llm.op03_token_files import token_files
from bitempo.llm.op04_mtree import top_k
from bitempo.llm.op05_html import extract_text
from bitempo.llm.op06_ngram_join import ngram_join
from bitempo.llm.op07_suffix_dedup import remove_repeats
from bitempo.llm.op08_warc import warc_round_trip
from bitempo.llm.op09_quality import resample
from bitempo.llm.op10_token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, block long, rows string, part int, `key` string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def docs(spark, empty=False):
    rows = [
        (1, LONG, "en", "a", 1, 7, "x", 3, "k"),
        (2, LONG, None, None, None, None, None, None, None),
        (2, LONG, None, None, None, None, None, None, None),
        (3, None, "en", "a", 0, 1, "x", 1, "k"),
        (4, "", "en", "a", 0, 1, "x", 1, "k"),
        (None, "a text without an id", "en", "a", 0, 1, "x", 1, "k"),
        (5, "  \n ", "en", "a", 0, 1, "x", 1, "k"),
        (6, "é" * 70 + " <|endoftext|> ½ 中 it's", "fr", "a", 0, 1, "x", 1, "k"),
        (7, "word " * 30_000, "en", "a", 0, 1, "x", 1, "k"),
    ]
    return spark.createDataFrame([] if empty else rows, DOC)


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def test_bpe(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    got = by_id(bpe_round_trip(docs(spark), PATH).collect())
    assert len(got) == 9
    texts = {r.doc_id: r.text or "" for r in docs(spark).collect()}
    for r in got:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_round_trip(docs(spark, True), PATH).count() == 0
    back = bpe_decode(bpe_encode(docs(spark), PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in docs(spark).collect())


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in docs(spark).collect()}
    for r in count_tokens(docs(spark), PATH, chunk=1000, overlap=40).collect():
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
    assert count_tokens(docs(spark, True), PATH).count() == 0


def test_token_files(spark):
    rows = by_id(token_files(docs(spark), PATH).collect())
    assert len(rows) == 9
    starts = sorted((r.start, r.n_tokens) for r in rows)
    at = 0
    for s, n in starts:
        assert s == at
        at += n
    assert min(rows, key=lambda r: r.start).doc_id is None
    assert token_files(docs(spark, True), PATH).count() == 0


def test_ngram_join(spark):
    rows = by_id(ngram_join(docs(spark)).collect())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == 9
    assert got[1] == (10, 1) and got[2] == (10, 1) and got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5)
    assert got[None][1] is None and got[7] == (1, 7)
    assert ngram_join(docs(spark, True)).count() == 0


def test_suffix_dedup(spark):
    rows = by_id(remove_repeats(docs(spark)).collect())
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and rows[0].rows == "x" and got[1].n_removed == 0
    assert got[2].n_removed == got[2].n_bytes and got[2].text == "" and got[2].n_spans == 1
    assert got[3].n_bytes == 0 and got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[7].n_removed == 0, "repeats within one document stay"
    assert remove_repeats(docs(spark, True)).count() == 0


def test_decontaminate(spark):
    bench = spark.createDataFrame([(1, "Eight, nine ten. eleven twelve thirteen!"), (2, None), (3, ""), (4, "without an"), (5, "not there at all really")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs(spark), bench).collect()}
    assert got == {(1, 1), (2, 1), (None, 4)}
    assert sorted(r.doc_id for r in decontaminate(docs(spark), bench).collect()) == [3, 4, 5, 6, 7]
    assert contaminated(docs(spark, True), bench).count() == 0
    assert decontaminate(docs(spark), bench.where("false")).count() == 9


@pytest.mark.parametrize("most", [0, 100_000])
def test_null_ids_at_any_benchmark_size(spark, most):
    bench = spark.createDataFrame([(1, "Eight, nine ten. eleven twelve thirteen!"), (None, "a text without an id"), (None, "three four five six seven eight"), (4, "without an")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start) for r in contaminated(docs(spark), bench, literal_grams=most).collect()), key=str)
    assert got == sorted([(1, 1, 7), (2, 1, 7), (1, None, 2), (2, None, 2), (None, None, 0), (None, 4, 2)], key=str)
    kept = decontaminate(docs(spark), bench.where("item_id is null"), literal_grams=most).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 5, 6, 7]


def test_long_items_that_end_in_one_repeated_word(spark):
    n, end = 30, 20
    items = [[f"i{i}w{j}" for j in range(200)] for i in range(n)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(i, " ".join(["before", *x[:-end], *["same"] * end, "after"])) for i, x in enumerate(items)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(df, bench).collect()} == {(i, i) for i in range(n)}


def test_rows_are_filtered_by_row(spark):
    """Rows that share an id, or have none, go or stay on their own."""
    clean = [f"clean {i} " + " ".join(f"c{i}w{j}" for j in range(12)) for i in range(4)]
    leak = f"before {LONG} after"
    rows = [(None, clean[0]), (None, leak), (None, clean[1]), (7, clean[2]), (7, leak), (8, clean[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    assert sorted(r.text for r in decontaminate(df, bench).collect()) == sorted(clean)
    rows = [(None, LONG), (None, LONG), (None, clean[0]), (None, clean[0]), (1, clean[1]), (2, clean[1]), (2, clean[2]), (3, clean[3]), (3, clean[3]), (9, LONG)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert by_id(got) == by_id([(9, LONG), (None, clean[0]), (1, clean[1]), (2, clean[2]), (3, clean[3])])


def test_quality(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resample(docs(spark), none).count() == 9
    assert resample(docs(spark, True), none).count() == 0
    good = [(i, f"the river runs past house {i % 7} and field {i % 5}", "en") for i in range(300)]
    bad = [(1000 + i, f"the river runs past house {i % 7} you blockhead {i % 5}", "en") for i in range(100)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good[::2]] + [(i, 1, 1) for i, _, _ in bad[::2]] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in resample(spark.createDataFrame(good + bad, "doc_id long, text string, lang string"), labels, temperature=0.05).collect()}
    assert kept == {i for i, _, _ in good}


def test_mtree(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.9, 0.1], 1), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 0.0], 1), (None, [1.0, 1.0], 1), (100, [-1.0, -0.5], 1)], "vec_id long, embedding array<float>, score int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(v).orderBy("query_id", "rank").collect()]
    assert [g[2] for g in got if g[0] == 0] == [1, 2, 100] and [g[2] for g in got if g[0] == 100] == [1, 2, 0]
    assert got[0][3] == 1024 * 921
    assert top_k(v.where("false")).count() == 0


def test_repeated_queries_keep_their_neighbours(spark):
    rows = [(0, [1.0, 0.0])] * 12 + [(0, [1.0])] + [(i, [i / 32, -i / 32]) for i in range(1, 21)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id) for r in top_k(v).collect())
    assert got == [(r, 21 - r) for r in range(1, 11)]
    two = spark.createDataFrame(rows + [(0, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id) for r in top_k(two).collect())
    assert got == sorted([(r, 21 - r) for r in range(1, 11)] + [(r, r) for r in range(1, 11)])


def pages(spark, empty=False):
    body = "<html><body><nav>Home</nav><article><h1>T &amp; t</h1><p>one  two<p>three<aside>x</aside><div class='comments'>no</div></article><footer>f</footer>"
    rows = [(3, "http://a.b/x", body, "z"), (1, "http://a.b/y", body, "z"), (2, None, None, "z"), (4, "u", "", "z"), (None, "u", body, "z"), (1, "http://a.b/y", body, "z"), (9, "http://c.d/1", "<p>menu one two three four five six</p><p>real alpha beta</p>", "q"), (10, "http://c.d/2", "<p>menu one two three four five six</p><p>other gamma delta</p>", "q"), (11, "v", "y" * 200_000, "w")]
    return spark.createDataFrame([] if empty else rows, "page_id long, url string, html string, text string")


def test_html(spark):
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract_text(pages(spark)).collect()}
    assert got[3, "http://a.b/x"] == ("T & t\none two\nthree", 19)
    assert got[2, None] == ("", 0) and got[4, "u"] == ("", 0)
    assert got[9, "http://c.d/1"][0] == "real alpha beta" and got[10, "http://c.d/2"][0] == "other gamma delta"
    assert extract_text(pages(spark)).count() == 9 and extract_text(pages(spark, True)).count() == 0


def test_html_marked_pages_reach_the_host(spark):
    menu = "<p>menu one two three four five six</p>"
    rows = [(1, "http://a.b/1", f"{menu}<article><p>said by both pages in their own articles</p></article>"), (2, "http://a.b/2", f"{menu}<article><p>said by both pages in their own articles</p></article><p>printed only here</p>"), (3, "http://a.b/3", f"{menu}<p>alone on this page</p>")]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "said by both pages in their own articles", 2: "said by both pages in their own articles\nprinted only here", 3: "alone on this page"}


def test_html_counts_over_the_whole_host(spark):
    """Each notice is on two pages in different blocks; copies of a page keep their text; hosts do not mix."""
    notice = lambda i: " ".join(f"notice{i}x{j}" for j in range(8))
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(9))
    rows = [(i, f"http://a.b/{i}", f"<p>{notice(i % 40)}</p><p>{own(i)}</p>") for i in range(80)]
    rows += [(i, f"http://copies.b/{i}", f"<p>{own('same')}</p>") for i in (100, 101)] + [(None, "http://copies.b/n", f"<p>{own('same')}</p>")]
    rows += [(200, "http://c.d/1", f"<p>{notice('host')}</p>"), (201, "http://e.f/1", f"<p>{notice('host')}</p><p>more</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    for size in (1, 1000, 8 << 20):
        got = {r.url: r.text for r in extract_text(df, block_bytes=size).collect()}
        assert len(got) == len(rows)
        assert all(got[f"http://a.b/{i}"] == own(i) for i in range(80))
        assert {got[f"http://copies.b/{x}"] for x in (100, 101, "n")} == {own("same")}
        assert got["http://c.d/1"] == notice("host") and got["http://e.f/1"] == notice("host") + "\nmore"


def test_warc(spark):
    import base64

    rows = warc_round_trip(pages(spark)).collect()
    assert len(rows) == 9
    html = {(r.page_id): (r.html or "").encode() for r in pages(spark).collect()}
    for r in rows:
        raw = html[r.page_id]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows)
    assert ("1", "response", None) in kinds and ("3", "revisit", 1) in kinds and ("None", "revisit", 1) in kinds
    assert ("2", "response", None) in kinds and ("4", "revisit", 2) in kinds
    assert warc_round_trip(pages(spark, True)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs(spark), d)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs(spark).columns, name
        assert out.count() <= 9
        assert stage(spark, docs(spark, True), d).count() == 0, name
    source = {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()}
    got = [r.doc_id for r in corpus_pipeline.run(spark, d).collect()]
    assert got and set(got) <= source and len(set(got)) == len(got)
