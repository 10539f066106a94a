"""Operator 5: main text of web pages.

A page's markup is read into blocks of text, each with the place it stands in: within
menus, headers, footers, sidebars, notices, adverts, forms, comments and the like
(which never count), within a marked article, or elsewhere. The host decides: the
token streams of all its pages are put together, and token strings that distinct pages
share are found by the suffixes' names (equal names are equal strings, prefix doubling
gives them). What these strings cover is boilerplate and goes; the unique runs of a
block stay. Markup only protects: a block within a marked article stays whole though
other pages repeat it. Pages are packed into blocks whatever their host; blocks
exchange hashes of their distinct strings, so a string counts over its whole host,
however large, and no host fills a task.

A null or empty html gives an empty text; very long pages are read like others. A null
url is a host of its own. Pages of a host with equal texts are one page when a
string's pages are counted, so copies of a page do not lose their text; repeated ids
have no meaning. Words that differ in the case of A-Z alone are the same. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.llm import blocks as B
from bitempo.llm import hashing as H
from bitempo.llm.spaces import shared_folder, tidied

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|math|select|title|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start or end ends a block of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no main text.
ASIDE = frozenset("nav footer aside form button dialog menu input label fieldset head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dialog footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
MAIN_ROLES = frozenset(["main", "article"])
MAIN_WORDS = frozenset("article content main post story entry".split())
WORDS = re.compile(r"[a-z0-9]+")
HOST = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)")


def place(name: str, attributes: str, inside: int) -> int:
    """0: never main text, 2: marked as the article, 1: neither."""
    if name in ASIDE or name == "header" and inside < 2:
        return 0
    if not attributes.strip():
        return 2 if name in ("article", "main") else 1
    found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    if role in ASIDE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return 0
    if name in ("article", "main", "body", "html"):
        words = set(WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}".lower())) if name == "article" else set()
        return 0 if words & {"comment", "comments", "ad", "ads", "advert", "advertisement", "promo", "sponsored", "related"} else 2 if name in ("article", "main") else 1
    names = re.findall(r"\S+", f"{found.get('class', '')} {found.get('id', '')}".lower())
    for n in names:
        w = WORDS.findall(n)
        if w and (w[0] in ASIDE_WORDS or w[-1] in ASIDE_WORDS):
            return 0
    if role in MAIN_ROLES or inside < 2 and name in ("div", "section") and any(WORDS.findall(n) and all(w in MAIN_WORDS or w in ("body", "text") for w in WORDS.findall(n)) for n in names):
        return 2
    return 1


def read_blocks(page: str) -> list[tuple[str, bool]]:
    """(text, whether it stands in the marked article) of the blocks in page order, without what is never main text."""
    blocks: list[tuple[str, bool]] = []
    stack: list[tuple[str, int]] = []
    text: list[str] = []
    now, at = 1, 0

    def end_block() -> None:
        nonlocal text
        if text:
            line = " ".join("".join(text).split())
            if line:
                blocks.append((line, now == 2))
            text = []

    for m in TOKEN.finditer(page):
        if now and m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            if now:
                text.append(" ")
            continue
        if m[2]:  # an end tag: what it leaves open is closed, unless nothing of that name is open
            i = len(stack) - 1
            while i >= 0 and stack[i][0] != name:
                i -= 1
            if name in BLOCK or i >= 0 and any(n in BLOCK for n, _ in stack[i:]):
                end_block()
            if i >= 0:
                del stack[i:]
                now = stack[-1][1] if stack else 1
            continue
        if name in BLOCK:
            end_block()
        if name in VOID or m[4].rstrip().endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            stack.pop()  # its end tag was left out
            now = stack[-1][1] if stack else 1
        kind = place(name, m[4], now)
        kind = 0 if now == 0 or kind == 0 else max(now, kind)
        if kind != now:
            end_block()
        now = kind
        stack.append((name, now))
    if now and at < len(page):
        text.append(html.unescape(page[at:]))
    end_block()
    return blocks


def read_page(page: str) -> tuple[list[str], list[str]]:
    """(blocks of the marked article, blocks elsewhere), in page order, without what is never main text."""
    blocks = read_blocks(page)
    return [x for x, marked in blocks if marked], [x for x, marked in blocks if not marked]


def pages_of(batches) -> Iterator[pa.RecordBatch]:
    """(page_id, url, text, marks): a line of text for each block, and for each line whether it stands in the marked article."""
    for b in batches:
        read = [read_blocks(raw or "") for raw in b.column(2).to_pylist()]
        texts, marks = ["\n".join(x for x, _ in r) for r in read], ["".join("01"[m] for _, m in r) for r in read]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(marks, pa.string())], ["page_id", "url", "text", "marks"])


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def hash_of(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def suffix_names(tokens: np.ndarray, length: int) -> np.ndarray:
    """A name for each position's suffix, by its first `length` tokens: equal strings have equal names. Prefix doubling: the names of two halves make the name of a whole. The last length - 1 positions have none."""
    name, known = tokens, 1
    while known < length and len(name):
        step = min(known, length - known)
        n = max(0, len(name) - step)
        name = H.mix(name[:n] * H.BASE + name[step : step + n] + np.uint64(known))
        known += step
    return name


def page_hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's host, and of its host and text."""
    data, starts, ends = B.strings(table, "text")
    raw = data.tobytes()
    hosts = np.array([hash_of(host_of(u).encode("utf-8", "surrogatepass")) for u in table.column("url").to_pylist()], np.uint64)
    sums = np.array([hash_of(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    return hosts, H.mix(hosts * H.BASE2 + sums)


class Streams:
    """Token streams of a block's pages, the same each time they are read. A string is `least` tokens of a page; strings of different hosts differ."""

    def __init__(self, table: pa.Table, least: int):
        self.table, self.least = table, least
        self.data, self.starts, self.ends = B.strings(table, "text")
        self.a, self.b, words = B.words(self.data, self.starts, self.ends)
        self.row = np.searchsorted(self.ends, self.a, side="right")
        hosts, self.pages = page_hashes(table)
        n = max(0, len(words) - least + 1)
        self.at = np.flatnonzero(self.row[:n] == self.row[least - 1 : least - 1 + n])
        self.hashes, self.kind = np.unique(suffix_names(H.mix(words + hosts[self.row]), least)[self.at], return_inverse=True)

    def counts(self, answers: list[dict], parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The strings, and how many pages have each; of equal pages the first in the first block that has some counts."""
        pages, first = np.unique(self.pages, return_index=True)
        mine = np.zeros(len(self.pages), bool)
        mine[first[bits_of(answers, pages, parts)]] = True
        some = mine[self.row[self.at]]
        pair = np.unique(self.kind[some] * len(self.pages) + self.row[self.at][some])
        return self.hashes, np.bincount(pair // max(1, len(self.pages)), minlength=len(self.hashes))

    def kept(self, totals: np.ndarray) -> list[str]:
        """Each page's text without what shared strings cover in unmarked lines."""
        edge = np.zeros(len(self.a) + 1, np.int64)
        hits = self.at[(totals >= 2)[self.kind]] if len(self.kind) else self.at
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + self.least, -1)
        gone = np.cumsum(edge)[:-1] > 0
        out = []
        first = np.searchsorted(self.a, np.append(self.starts, len(self.data))).tolist()
        for i, marks in enumerate(self.table.column("marks").to_pylist()):
            a, b = first[i], first[i + 1]
            text = self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8")
            if "0" not in marks or not gone[a:b].any():
                out.append(text)
                continue
            lines, at = [], a
            for line, mark in zip(text.split("\n"), marks, strict=True):
                tokens = line.split(" ")
                here = gone[at : at + len(tokens)]
                at += len(tokens)
                stay = tokens if mark == "1" else [t for t, g in zip(tokens, here.tolist(), strict=True) if not g]
                if stay:
                    lines.append(" ".join(stay))
            out.append("\n".join(lines))
        return out


def send_pages(table: pa.Table, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, page hashes) for each range that has some."""
    pages = np.unique(page_hashes(table)[1])
    bounds = B.ranges(pages, parts)
    for p in range(parts):
        if bounds[p] < bounds[p + 1]:
            yield p, B.squeeze(pages[bounds[p] : bounds[p + 1]])


def first_blocks(rows: list[dict]) -> list[bytes]:
    """For each row's pages, as bits, whether it is the first row that has them."""
    pages = [B.spread(r["pages"]) for r in rows]
    first = np.unique(np.concatenate(pages), return_index=True)[1]
    mine = np.zeros(sum(map(len, pages)), bool)
    mine[first] = True
    return [np.packbits(x).tobytes() for x in np.split(mine, np.cumsum([len(x) for x in pages])[:-1])]


def bits_of(answers: list[dict], hashes: np.ndarray, parts: int) -> np.ndarray:
    """The answers' bits for a block's ascending hashes."""
    bounds, out = B.ranges(hashes, parts), np.zeros(len(hashes), bool)
    for x in answers:
        a, b = int(bounds[x["part"]]), int(bounds[x["part"] + 1])
        out[a:b] = np.unpackbits(np.frombuffer(x["reply"], np.uint8), count=b - a)
    return out


def extract_text(pages: DataFrame, least: int = 6, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    folder = shared_folder(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    read = source.mapInArrow(tidied(pages_of), "page_id long, url string, text string, marks string")
    blocks = B.pack(read, f"{folder}/pages", "page_id", "text", block_bytes)
    parts, _ = B.scale(blocks)

    def send(batches):
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = list(send_pages(B.from_ipc(raw.as_buffer()), parts))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "part", "pages"])

    firsts = B.exchange(blocks.select("block", "rows").mapInArrow(tidied(send), "block long, part int, pages binary"), first_blocks, f"{folder}/firsts")
    totals = B.shared_counts(blocks, lambda t, answers: Streams(t, least).counts(answers, parts), f"{folder}/strings", firsts)

    def finish(batches):
        for b in batches:
            for raw, answers in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                streams = Streams(B.from_ipc(raw.as_buffer()), least)
                texts = pa.array(streams.kept(B.counts_of(answers or [])), pa.string())
                t = streams.table
                yield from pa.table({"page_id": t.column("page_id"), "url": t.column("url"), "text": texts}).combine_chunks().to_batches()

    runs = B.with_answers(blocks, totals).mapInArrow(tidied(finish), "page_id long, url string, text string")
    return runs.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
