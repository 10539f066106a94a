"""Operator 8: WARC archives, written and read back.

Writing: each page becomes a record. The page with the smallest id of those with the
same payload (at least ``least`` bytes) is a response, the others revisit it. A
response's block is an HTTP message in chunked framing; a block of more than
``segment`` bytes is cut into a first segment and continuation records. Archives are
gzip files of WARC/1.1 records, written by Spark's own writer, whose line separator
is the end of a record.

Reading: records are parsed from the files; continuation records are grouped by their
origin's identifier, put in the order of their segment numbers, and their total
length is verified; then chunked framing is undone and the payload's digest verified.

A null html is an empty payload. A null url leaves the target out. A null page id
comes back null; it refers to others, but is referred to only where its whole group
has null ids, and then as null. Rows that repeat the response's id are responses too.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.llm.spaces import drop, shared_folder, through

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, origin string, number long, total long, block binary"
COLUMNS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def urn(page_id: int | None, sha: str, number: int = 1) -> str:
    """Identifier of a record; the digest keeps apart rows that repeat an id with another payload."""
    return f"<urn:page:{'' if page_id is None else page_id}:{sha}:{number}>"


def page_of(uri: str) -> int | None:
    body = uri.strip("<>").split(":")[2]
    return int(body) if body else None


def chunked(payload: bytes, size: int) -> bytes:
    out = []
    for a in range(0, len(payload), size):
        part = payload[a : a + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """The payload of a body in chunked framing."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        n = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if n == 0:
            return b"".join(out)
        part = body[at : at + n]
        if len(part) != n or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(part)
        at += n + 2


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def records(page_id, url, payload: bytes, refers: tuple | None, segment: int, chunk: int, date: str) -> Iterator[bytes]:
    """The records of one page, without the end of record."""
    common = [("WARC-Date", date)] + ([("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url is not None else [])
    own = digest(payload)
    sha = [("WARC-Payload-Digest", f"sha1:{own}")]
    kind = [("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield header([("WARC-Type", "revisit"), ("WARC-Record-ID", urn(page_id, own)), *common, *sha, ("WARC-Refers-To", urn(refers[0], own)), ("WARC-Profile", PROFILE), *kind, ("Content-Length", str(len(block)))]) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", urn(page_id, own)), *common, *sha, *kind]
    if len(block) <= segment:
        yield header([*head, ("Content-Length", str(len(block)))]) + block
        return
    cuts = range(0, len(block), segment)
    for i, a in enumerate(cuts, 1):
        part = block[a : a + segment]
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(cuts) else []
        more = [("WARC-Segment-Number", str(i)), ("Content-Length", str(len(part)))]
        if i == 1:
            yield header([*head, *more]) + part
        else:
            yield header([("WARC-Type", "continuation"), ("WARC-Record-ID", urn(page_id, own, i)), *common, ("WARC-Segment-Origin-ID", urn(page_id, own)), *last, *more]) + part


def write_warc(pages: DataFrame, path: str, least: int = 0, segment: int = 1 << 15, chunk: int = 1 << 12, date: str = "1970-01-01T00:00:00Z", per_file: int = 20_000) -> None:
    """Write the pages' archives at path."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    same = [F.sha1("payload").alias("sha"), F.length("payload").alias("size"), F.xxhash64("payload").alias("check")]
    firsts = rows.where(F.length("payload") >= least).groupBy(*same).agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    marked = rows.select("*", *same).join(firsts, ["sha", "size", "check"], "left").select("page_id", "url", "payload", "first", (F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for page_id, url, raw, first, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in records(page_id, url, raw, (first,) if revisit else None, segment, chunk, date):
                    held.append(r)
                    size += len(r)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    out = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    out.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_records(raw: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a gzip file, which is inflated piece by piece."""
    z, buf, at, fed = zlib.decompressobj(wbits=31), bytearray(), 0, 0

    def fill() -> bool:
        nonlocal buf, at, z, fed
        if at > 1 << 20:
            del buf[:at]
            at = 0
        tail = z.unconsumed_tail
        if z.eof:
            rest = z.unused_data
            if not rest and fed >= len(raw):
                return False
            z = zlib.decompressobj(wbits=31)
            tail = rest
        if not tail:
            if fed >= len(raw):
                return False
            tail = bytes(raw[fed : fed + (1 << 16)])
            fed += len(tail)
        buf += z.decompress(tail, 1 << 20)
        return True

    while True:
        while (stop := buf.find(END, at)) < 0:
            if not fill():
                if bytes(buf[at:]).strip():
                    raise ValueError("the archive ends within a record's header")
                return
        lines = bytes(buf[at:stop]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        n = int(fields["content-length"])
        at = stop + 4
        while len(buf) - at < n + 4:
            if not fill():
                raise ValueError("the archive ends within a record's block")
        block = bytes(buf[at : at + n])
        if buf[at + n : at + n + 4] != END:
            raise ValueError("a record does not end where its length says")
        at += n + 4
        yield fields, block


def finished(fields: dict[str, str], block: bytes) -> dict:
    """The row of a whole record."""
    head, _, body = block.partition(END)
    http = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode().split("\r\n")[1:])}
    row = {"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:")}
    if row["record_type"] == "revisit":
        return row | {"payload_bytes": int(http["content-length"]), "refers_to": page_of(fields["warc-refers-to"])}
    payload = dechunk(body) if http.get("transfer-encoding") == "chunked" else body
    if digest(payload) != row["payload_digest"]:
        raise ValueError("a payload does not have its digest")
    return row | {"payload_bytes": len(payload), "refers_to": None}


def read_warc(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each page in the archives at path."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                held, size = [], 0
                for fields, block in parse_records(memoryview(raw.as_buffer())):
                    if "warc-segment-number" in fields:
                        kind = fields["warc-type"]
                        row = {"origin": fields.get("warc-segment-origin-id", fields["warc-record-id"]), "number": int(fields["warc-segment-number"]), "total": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None, "block": block}
                        row |= {"page_id": page_of(row["origin"]), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_digest": fields.get("warc-payload-digest")}
                        size += len(block)
                    else:
                        row = finished(fields, block)
                    held.append(row)
                    size += 200
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    def whole(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["number"], r["block"]))
        out = []
        copies = sum(r["number"] == 1 for r in rows)  # rows with a repeated id give their segments once each
        for c in range(copies):
            own = rows[c::copies]
            block = b"".join(r["block"] for r in own)
            if [r["number"] for r in own] != list(range(1, len(own) + 1)) or len(block) != own[-1]["total"]:
                raise ValueError("a segmented record is not whole")
            first = own[0]
            fields = {"warc-record-id": first["origin"], "warc-type": "response", "warc-payload-digest": first["payload_digest"]}
            out.append(finished(fields, block) | {"url": first["url"]})
        return pa.Table.from_pylist([{k: r[k] for k in COLUMNS} for r in out], pa.schema([f for f in schema if f.name in COLUMNS]))

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    rows = through(files.mapInArrow(run, ROW), f"{folder}/records")
    segmented = rows.where("block is not null").groupBy("origin").applyInArrow(whole, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return rows.where("block is null").select(*COLUMNS).unionByName(segmented)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    write_warc(pages, f"{folder}/archives")
    out = read_warc(spark, f"{folder}/archives", folder)
    drop(spark, f"{folder}/archives")
    return out.drop("url")
