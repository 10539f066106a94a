"""The operators' own algorithms against brute force."""

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard

from bitempo.llm import blocks as B
from bitempo.llm import hashing as H
from bitempo.llm import op07_suffix_dedup as dedup
from bitempo.llm.backends import LibraryBackend, encoder
from bitempo.llm.op04_mtree import MTree
from bitempo.llm.op05_html import read_page
from bitempo.llm.op06_ngram_join import link_all, shingles
from bitempo.llm.op08_warc import chunked, dechunk
from bitempo.llm.op09_quality import best_cut, kth_largest
from bitempo.llm.op10_token_counts import encode_huge
from bitempo.llm.pieces import Encoder, cut
from bitempo.llm.suffixes import suffix_array

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "1", "23", ".", "!!", "é", "ñ", "²", "½", "中", "<|endoftext|>", "I", "'ve", "'d", "'T", "\r\n", "\x1c", "…", "€"]


def test_encoders_match_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for kind in ("heap", "library"):
        ids, off = encoder(kind, PATH).encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want
    e = encoder("library", PATH)
    for text in ["a" * 3000, "  \n " * 900, "ab cd  " * 700, " 's" * 900, "x <|endoftext|> y " * 200]:
        assert encode_huge(e, text, 200, 16).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_pieces_with_nul_are_told_apart():
    from tokenizers import Tokenizer

    texts = ['"', "!\x00", "!", "\x00", "\x00\x00", "a\x00", "b"]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for kind in ("heap", "library"):
        ids, off = encoder(kind, PATH).encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want


def test_new_pieces_cost_one_merge_each():
    """New pieces go to the library's model, not through its splitting again, and leave the entries already held where they are."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    texts = [" ".join(words[a : a + 100]) for a in range(0, 6000, 100)]
    e = Encoder(LibraryBackend(PATH))
    want = [e.backend.whole(t) for t in texts]
    e.backend.tokenizer = None
    ids, off = e.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want
    e.encode(["erster"])
    held = e.keys
    assert e.encode(["neuer Text"])[0].tolist() == LibraryBackend(PATH).whole("neuer Text") and e.keys is held


def test_pieces_are_found_again_in_a_full_or_crowded_cache(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    want = [encoder("library", PATH).backend.whole(t) for t in texts]

    def agrees(e):
        for _ in range(2):
            for a in range(0, 600, 50):
                ids, off = e.encode(texts[a : a + 50])
                assert [ids[x:y].tolist() for x, y in zip(off[:-1], off[1:], strict=True)] == want[a : a + 50]

    agrees(Encoder(LibraryBackend(PATH), capacity=100))
    e = Encoder(LibraryBackend(PATH))
    e.backend.merge = None  # as for tokenizers that do more than split and merge
    agrees(e)
    mix = H.mix
    monkeypatch.setattr(H, "mix", lambda x: mix(x) & ~np.uint64(0xFFFF))  # all in one slot
    agrees(Encoder(LibraryBackend(PATH)))
    turn = itertools.count()
    monkeypatch.setattr(H, "mix", lambda x: mix(x) if next(turn) % 2 else mix(x) >> np.uint64(56))  # equal first hashes
    agrees(Encoder(LibraryBackend(PATH)))


def test_long_texts_without_boundary_stay_whole():
    assert cut("ab\n" * 10, 8) == ["ab\n" * 10]
    assert cut("ab " * 5 + "c" * 9000, 8) == ["ab ab ab", " ab ab " + "c" * 9000]


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(100):
        s = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60)))
        assert suffix_array(s)[0].tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def removed(documents, blocks, hot, parts=5):
    shape = dedup.Shape(50, 28)
    dealt = [documents[i::blocks] for i in range(blocks)]
    own = [dedup.Block(pa.table({"doc_id": pa.array([x[0] for x in b], pa.int64()), "text": pa.array([x[1].decode() for x in b])}), "doc_id", "text", shape) for b in dealt]
    sent = [list(B.send_hashes(*b.hashes(), 48, parts)) for b in own]
    answers = [[] for _ in own]
    for p in range(parts):
        some = [(k, r) for k, s in enumerate(sent) for r in s if r[0] == p]
        for (k, _), reply in zip(some, B.total_counts([{"hashes": r[1], "counts": r[2]} for _, r in some]) if some else [], strict=True):
            answers[k].append({"part": p, "reply": reply})
    totals = [B.counts_of(a) for a in answers]
    entries = [list(dedup.send_entries(b, t, hot, parts)) for b, t in zip(own, totals, strict=True)]
    masks = [[np.zeros(0, np.uint32)] for _ in own]
    for p in range(parts):
        some = [(k, r) for k, s in enumerate(entries) for r in s if r[0] == p]
        for (k, _), reply in zip(some, dedup.resolve([{"n": r[1], "entries": r[2]} for _, r in some], shape) if some else [], strict=True):
            masks[k].append(np.frombuffer(zstandard.ZstdDecompressor().decompress(reply), np.uint32))
    out = {}
    for b, t, m, d in zip(own, totals, masks, dealt, strict=True):
        gone = dedup.covered(b, t, np.concatenate(m), hot)
        for i, (key, _) in enumerate(d):
            out[key] = gone[b.starts[i] : b.ends[i]].tolist()
    return out


def test_repeats_match_brute_force():
    rng = random.Random(5)
    for _ in range(25):
        base = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(0, 300))) for _ in range(6)]
        documents = []
        for i in range(rng.randint(1, 20)):
            t = bytearray(b"".join(rng.choice(base)[rng.randint(0, 100) :] for _ in range(rng.randint(0, 4))))
            for _ in range(rng.randint(0, 4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(b"pq")
            documents.append((i, bytes(t)))
        seen = {}
        for i, t in documents:
            for p in range(len(t) - 49):
                seen[t[p : p + 50]] = min(seen.get(t[p : p + 50], i), i)
        want = {}
        for i, t in documents:
            g = [False] * len(t)
            for p in range(len(t) - 49):
                if seen[t[p : p + 50]] < i:
                    g[p : p + 50] = [True] * 50
            want[i] = g
        for hot in (1024, 2):
            for n in (1, 3):
                assert removed(documents, n, hot) == want


def test_kept_rows_take_memory_in_proportion_to_their_bytes():
    """What a worker holds beside a block, in bytes for each byte of text: once for what is kept and once for its column, not several sums for each byte."""
    rng = np.random.default_rng(11)
    texts = ["".join(map(chr, rng.integers(97, 123, 1000))) for _ in range(1000)]
    block = dedup.Block(pa.table({"doc_id": list(range(1000)), "text": texts}), "doc_id", "text", dedup.Shape(50, 28))
    totals = np.full(len(block.distinct), 2)
    _, (_, mask, _, _) = block.entries(totals, 1024)
    assert dedup.covered(block, totals, mask, 1024).all()  # every window has an earlier copy
    gone = np.zeros(len(block.data), bool)
    gone[[0, 1, 2, 500, 999, 1000, 2998, 2999]] = True
    tracemalloc.start()
    try:
        out = dedup.digest(block, gone, ["doc_id", "text"], "text")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * len(block.data)
    rows = out.slice(0, 4).to_pylist()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows] == [(1000, 5, 3), (1000, 1, 1), (1000, 2, 1), (1000, 0, 0)]
    assert [r["text"] for r in rows] == [texts[0][3:500] + texts[0][501:999], texts[1][1:], texts[2][:998], texts[3]]
    assert [r["kept_sha256"] for r in rows] == [hashlib.sha256(r["text"].encode()).hexdigest() for r in rows]


def test_prefix_tree_links():
    rng = random.Random(7)
    for _ in range(120):
        base = [rng.sample(range(1000), rng.randint(3, 40)) for _ in range(4)]
        sets = []
        for _ in range(rng.randint(2, 30)):
            b = set(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                b ^= {rng.randrange(1000)}
            sets.append(b or {1})
        df = {}
        for s in sets:
            for x in s:
                df[x] = df.get(x, 0) + 1
        shared = [np.array(sorted((x for x in s if df[x] > 1), key=lambda x: (df[x], x)), np.uint64) for s in sets]
        able = [100 * len(h) >= 80 * len(s) for h, s in zip(shared, sets, strict=True)]
        keep = [i for i, a in enumerate(able) if a]
        first = link_all([len(sets[i]) for i in keep], [shared[i] for i in keep], 80)
        got = {i: keep[f] for i, f in zip(keep, first, strict=True)}
        p = list(range(len(sets)))

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    p[max(a, b)] = min(a, b)
        assert [got.get(i, i) for i in range(len(sets))] == [find(i) for i in range(len(sets))]


def test_words_and_shingles():
    texts = ["The  the\tTHE é\x0bx y", "", "one two", "a b c d e f a b c d e"]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(t) for t in raw])
    starts = ends - [len(t) for t in raw]
    at, _, w = B.words(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
    b = np.searchsorted(at, np.append(starts, ends[-1]))
    for i, t in enumerate(raw):
        own = re.findall(rb"[^\x20\x09-\x0D]+", t)
        assert b[i + 1] - b[i] == len(own)
        lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in own]
        n = len({tuple(lower[k : k + 5]) for k in range(len(lower) - 4)}) if len(lower) >= 5 else int(bool(lower))
        assert len(shingles(w[b[i] : b[i + 1]], 5)) == n
    assert w[b[0]] == w[b[0] + 1] == w[b[0] + 2]


def test_mtree_is_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (700, 6))
    x[::7] = x[0]
    t = MTree(np.arange(700), x, int((x * x).sum(axis=1).max()), page=16)
    for q in range(0, 700, 23):
        s = x @ x[q]
        want = sorted(((int(s[i]), i) for i in range(700) if i != q), key=lambda p: (-p[0], p[1]))[:10]
        assert t.search(x[q], q, 10)[0] == want


def test_chunked_framing():
    for raw in (b"", b"x", b"abc\r\n0\r\n\r\n" * 50):
        assert dechunk(chunked(raw, 7)) == raw


def test_broken_markup():
    assert read_page("<article><p>a<b>b</p>c<script>x</script><!-- n -->d &lt;e&gt;</article>tail")[0] == ["ab", "cd <e>"]
    assert read_page("<div class='ad'>x</div><article>y<div id='cookie-notice'>z")[0] == ["y"]


def test_sample_bounds(spark):
    rng = random.Random(4)
    v = [rng.choice([rng.gauss(0, 1), 0.5, -3.0]) for _ in range(9000)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    for k in (1, 2, 4000, 9000):
        assert kth_largest(df, "x", k) == sorted(v, reverse=True)[k - 1]
    assert best_cut([0.0, 0.1, -5.0], [True, True, False])[1] == -2.5
