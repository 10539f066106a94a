"""Whole operators against brute force, over several blocks, shares, files and ranges."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import zstandard

import corpus_pipeline
from bitempo.llm import blocks as B
from bitempo.llm.backends import encoder
from bitempo.llm.op02_decontaminate import contaminated
from bitempo.llm.op03_token_files import parse, read_document, read_files, write_files
from bitempo.llm.op04_mtree import top_k
from bitempo.llm.op05_html import extract_text, read_blocks
from bitempo.llm.op06_ngram_join import ngram_join
from bitempo.llm.op07_suffix_dedup import remove_repeats
from bitempo.llm.op09_quality import COST, LEAST, log_ratios, resample
from bitempo.llm.op10_token_counts import encode_huge
from bitempo.llm.spaces import bounded_sample, shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def runs(words, k=5):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)]


def test_decontamination_finds_every_window(spark):
    """All windows of an item's length, wherever they start; items of 3 to 90 words, copied with some words changed, dropped or added."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 15, 40, 90]))] for _ in range(60)]
    docs = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 3:
            copy = list(rng.choice(items))
            for _ in range(rng.randint(0, 1 + len(copy) // 30)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["other"], [copy[at], "added"]])
            cut = rng.randint(0, len(words))
            words = words[:cut] + copy + words[cut:]
        docs.append(words)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    want = set()
    for i, w in enumerate(docs):
        for j, item in enumerate(items):
            own = runs(item)
            if w and any(jaccard(runs(w[s : s + len(item)]), own) >= 0.8 for s in range(max(1, len(w) - len(item) + 1))):
                want.add((i, j))
    for most in (100_000, 0):
        got = {(r.doc_id, r.item_id) for r in contaminated(df, bench, literal_grams=most).collect()}
        assert len(want) > 45 and not got - want and len(want - got) <= 0.02 * len(want)


def test_token_files_over_many_files(spark):
    rng = random.Random(12)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a b c", "it's <|endoftext|> é", "word " * rng.randint(1, 900)])) for _ in range(300)]
    rows += [(7, f"hot {i} " * 20) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = shared_folder(spark)
    dictionary = write_files(df, folder, PATH, samples=50, dict_bytes=1 << 10, file_bytes=300)
    assert dictionary
    got = sorted(read_files(spark, folder).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    at, e = 0, encoder("library", PATH)
    want = defaultdict(list)
    for k, t in rows:
        ids = np.append(e.encode([t or ""])[0], 2)
        want[k].append((len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
    seen = defaultdict(list)
    for r in got:
        assert r.start == at
        at += r.n_tokens
        seen[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert [r.doc_id is None for r in got] == sorted((r.doc_id is None for r in got), reverse=True)
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(f"{folder}/files").where("length > 0").collect()]
    assert len(files) > 20, "parts are cut by bytes"
    for raw in files[:5]:
        _, _, size, index = parse(memoryview(raw), dictionary)
        one = read_document(memoryview(raw), dictionary, len(index) - 1)
        assert len(one) == index["ids"][-1] and one[-1] == 2
        a, n = int(index["offset"][0]), int(index["size"][0])
        assert len(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(raw[a : a + n])) == size * index["ids"][0]


def test_samples_hold_different_rows(spark):
    df = spark.createDataFrame([("same",)] * 900 + [(f"t{i}",) for i in range(100)], "text string")
    assert len({r.text for r in bounded_sample(df, ["text"], 60)}) == 60
    assert len(bounded_sample(df, ["text"], 5000)) == 101


def test_top_k_over_many_shares(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(600, 5)).round(2)
    x[::3] = x[0]  # a third of all rows are one vector
    rows = [(i, [float(c) for c in v[: 5 if i % 4 else 3]]) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (600, [float("inf")] * 5), (700, [1e300] * 5)], "vec_id long, embedding array<double>").repartition(4)
    whole = np.zeros((600, 5), np.int64)
    for i, v in rows:
        whole[i, : len(v)] = [math.floor(1024 * c) for c in v]
    got = defaultdict(list)
    for r in top_k(df, every=20, share=50, block=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    for q, found in got.items():
        s = whole @ whole[q]
        assert found == [(i, int(s[i])) for i in sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:10]]


def test_extraction_removes_covered_runs(spark):
    """Random unmarked and marked pages over hosts: words covered by 6-word strings of another page of the host go, all others stay."""
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(400)]
    said = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 14))] for _ in range(12)]
    pages = []
    for i in range(160):
        parts = []
        for _ in range(rng.randint(0, 5)):
            own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]
            other = rng.choice(said)
            at = rng.randint(0, len(own))
            tag = rng.choice(["p", "p", "article"])
            parts.append((tag, own[:at] + (other if rng.random() < 0.6 else []) + own[at:]))
        pages.append((i, f"http://h{i % 3}.x/{i}", "".join(f"<{t}>{' '.join(w)}</{t}>" for t, w in parts)))
    pages += [(500 + i, "http://h0.x/copy", pages[0][2]) for i in range(30)]
    streams = {}
    for i, url, page in pages:
        streams[i] = [(text.split(" "), marked) for text, marked in read_blocks(page)]
    carriers = defaultdict(set)
    for i, url, _ in pages:
        flat = [w for line, _ in streams[i] for w in line]
        for j in range(len(flat) - 5):
            carriers[url.split("/")[2], tuple(flat[j : j + 6])].add(tuple(w for w in ["\n".join(" ".join(line) for line, _ in streams[i])]))
    want = {}
    for i, url, _ in pages:
        flat = [w for line, _ in streams[i] for w in line]
        gone = [False] * len(flat)
        for j in range(len(flat) - 5):
            if len(carriers[url.split("/")[2], tuple(flat[j : j + 6])]) > 1:
                gone[j : j + 6] = [True] * 6
        at, out = 0, []
        for line, marked in streams[i]:
            stay = [w for w, g in zip(line, gone[at : at + len(line)], strict=True) if marked or not g]
            at += len(line)
            if stay:
                out.append(" ".join(stay))
        want[i] = "\n".join(out)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    for size in (1, 3000, 1 << 20):
        assert {r.page_id: r.text for r in extract_text(df, block_bytes=size).collect()} == want
    assert any("w" in t for t in want.values())


def test_references_are_decoded_by_run():
    assert read_blocks("<p>a &am<b>p;</b> &amp;lt; &#233;</p>") == [("a &amp; &lt; é", False)]


def test_join_of_large_groups(spark):
    """Candidate groups far beyond one share, near copies of one text and copies of one set."""
    rng = random.Random(15)
    base = [[f"w{rng.randrange(50)}" for _ in range(60)] for _ in range(5)]
    docs = [" ".join(b) for b in base for _ in range(6)]
    for _ in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        docs.append(" ".join(w))
    sets = [set(runs(d.split(" "))) for d in docs]
    low = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
        if all(low[low[i]] == low[i] for i in range(len(docs))):
            break
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(6)
    for big in (1500, 4):
        got = {r.doc_id: r.component_id for r in ngram_join(df, big=big).collect()}
        assert [got[i] for i in range(len(docs))] == low


CODE = re.compile(r"[^\W_]+", re.A)


def plain_features(text):
    """The features of a text, as strings and tuples instead of hashes."""
    out, shapes, before = set(), [], None
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", text.encode()):
        raw = m[0]
        word = raw.lower()
        mark = not re.match(rb"[0-9A-Za-z\x80-\xff]", raw)
        upper = len(re.findall(rb"[A-Z]", raw))
        shape = word if mark else b"digit" if re.search(rb"[0-9]", raw) else b"upper" if upper > 1 and 2 * upper > len(raw) else b"title" if re.match(rb"[A-Z]", raw) else b"lower"
        if not mark and word == before:
            shape = b"again"
        before = word
        out.add(word)
        shapes.append((mark, shape))
    for n in (2, 3, 5):
        out |= {tuple(shapes[i : i + n]) for i in range(len(shapes) - n + 1)}
    return out


def test_classifier_against_plain_counts(spark):
    rng = random.Random(16)
    good = [f"w{i}" for i in range(40)]
    bad = [f"B{i}!" for i in range(40)]
    rows = []
    for i in range(240):
        own = good if i % 2 == 0 else bad + good[:10]
        rows.append((i, " ".join(rng.choice(own) for _ in range(rng.randint(1, 30)))))
    labels = [(i, int(i % 2 == 0), 0) for i in range(0, 240, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    feats = {i: plain_features(t) for i, t in rows}
    told = {i for i, q, _ in labels if q}
    raw, target = Counter(), Counter()
    for i, f in feats.items():
        raw.update(f)
        if i in told:
            target.update(f)
    ratio = {f: float(log_ratios(np.array([[raw[f]], [target[f]]]), (len(rows), len(told)), 3.0)[0]) for f in raw}
    for temperature in (0.05, 1.0):
        kept = {r.doc_id: r for r in resample(df, lab, whole=False, temperature=temperature).collect()}
        whole = {r.doc_id for r in resample(df, lab, temperature=temperature).collect()}
        assert set(kept) == whole
        scores = {x: {i: sum(r for r in (ratio[f] for f in fs) if abs(r) >= x) for i, fs in feats.items()} for x in LEAST}
        fits = [x for x in LEAST if all(abs(scores[x][i] - r.log_weight) < 1e-3 for i, r in kept.items())]
        assert fits, "log weights are sums of plain log ratios"
        good_kept = sum(i % 2 == 0 for i in kept)
        assert good_kept >= 110 and len(kept) - good_kept <= 12 and COST > 1
        noise = [r.sample_key - r.log_weight / temperature for r in kept.values()]
        assert 0.2 < np.mean(noise) < 1.2, "Gumbel noise has mean 0.58"


def test_huge_texts_without_boundaries():
    import time

    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(PATH), encoder("library", PATH)
    rng = random.Random(17)
    texts = ["中" * 5000, "".join(rng.choice(["ab", "'ll", " ", "  ", "\n", "<|endoftext|>", "1", "!", "é", "中文"]) for _ in range(6000)), " " * 3000 + "x", "a" * 2500 + " b" * 2000, "x<|endoftext|>" * 400]
    for text in texts:
        for chunk, overlap in ((64, 8), (700, 64), (1 << 14, 512)):
            assert encode_huge(e, text, chunk, overlap).tolist() == t.encode(text, add_special_tokens=False).ids
    took = []
    for n in (20_000, 160_000):
        text, start = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(n)), time.time()
        encode_huge(e, text, 1 << 12, 256)
        took.append(time.time() - start)
    assert took[1] < 40 * max(took[0], 0.02)


def test_nothing_is_left_in_the_catalog(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h")], "doc_id long, text string")
    ngram_join(df).collect()
    remove_repeats(df).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def test_stages_with_clashing_columns(spark):
    names = ["doc_id", "text", "n_chars", "n_bytes", "n_removed", "kept_sha256", "row", "weights", "noise", "at", "component_id", "similarity", "key", "id"]
    long = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(i, long if i % 2 else f"{long} {i}", i, *(["x"] * (len(names) - 3))) for i in range(6)], ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "/root/testdata/sf0.001")
        assert out.columns == names, name
        assert all(r.n_bytes == "x" and r["at"] == "x" for r in out.collect()), name


def test_ranges_skip_what_is_empty():
    h = np.array([5, 1 << 63, (1 << 64) - 1], np.uint64)
    sent = list(B.send_hashes(h, np.ones(3, np.int64), 64, 1000))
    assert [p for p, _, _ in sent] == [0, 500, 999]
