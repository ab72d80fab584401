"""WARC archives: writing captures, and assembling transactions from what is read back.

A capture is written as three records: the request, the response (or a revisit of one of equal
payload) and a metadata record; request and metadata name the response in WARC-Concurrent-To. Each
row is a capture with identifiers of its own, whatever its page_id.
Records are text (the payload is UTF-8), so Spark's own text writer, with the two line ends that
close a record as its separator, writes valid archives to any store and commits them like any
other output. A row that it gets is a stretch of records of bounded bytes, and a file a bounded number
of rows. Reading unpacks a file bit by bit, holds one record at a time, cut by Content-Length, and brings
the records of a transaction together by the identifier that they are concurrent to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import saved, scratch_path, table

#: Payloads of so many bytes at least may become revisits; bytes after which a stretch of records is
#: written; stretches of a file at most; packed bytes that are unpacked at a time.
REVISIT_BYTES, STRETCH, FILE_STRETCHES, PACKED = 1000, 4 << 20, 64, 1 << 20
# Fixed values of the format.
VERSION, LINE, CLOSE = "WARC/1.1", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = "id string, concurrent_to string, kind string, uri string, capture long, refers_to string, declared_digest string, payload binary, payload_bytes long, payload_digest string, block string"


def record_id(kind: str, capture: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{capture}')}>"


def header(kind: str, capture: str, page: int | None, length: int, fields: list[tuple[str, str]]) -> str:
    own = record_id("response" if kind == "revisit" else kind, capture)
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", *([f"X-Capture: {page}"] if page is not None else []), *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return LINE.join(lines) + CLOSE


def clean_uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def transaction(capture: str, page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> list[str]:
    """The three records of a capture, without the line ends that close them. capture names it among all."""
    uri, digest = clean_uri(url), "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = [("WARC-Target-URI", uri)] if uri else []
    together = [("WARC-Concurrent-To", record_id("response", capture))]
    get = f"GET {uri or '/'} HTTP/1.1{CLOSE}"
    http = f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: {len(payload)}{CLOSE}"
    about = f"payload-bytes: {len(payload)}{LINE}payload-sha1: {hashlib.sha1(payload).hexdigest()}{LINE}"
    kind, body, more = "response", http + payload.decode("utf-8", "surrogatepass"), []
    if refers_to is not None:
        kind, body, more = "revisit", http, [("X-Refers-To-Capture", str(refers_to)), ("WARC-Refers-To-Date", DATE), ("WARC-Profile", PROFILE)]
    size = lambda s: len(s.encode("utf-8", "surrogatepass"))
    return [
        header("request", capture, page, size(get), [*target, *together, ("Content-Type", "application/http;msgtype=request")]) + get,
        header(kind, capture, page, size(http) + (len(payload) if kind == "response" else 0), [*target, *more, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]) + body,
        header("metadata", capture, page, size(about), [*target, *together, ("Content-Type", "application/warc-fields")]) + about,
    ]


def write_warc(pages: DataFrame, out: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes pages (page_id, url, html) as gzipped archives to the folder out, each row as a capture.

    Of pages of one payload of revisit_bytes bytes or more, those of the largest page_id are responses
    and the others revisit it, also those of no page_id; where none has one, all are responses. A null
    html is an empty payload. Repeated rows and page_ids are captures of their own. Other columns are
    not looked at. An empty table writes no record.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("_key", F.when(F.length("payload") >= revisit_bytes, F.concat(F.sha2("payload", 256), F.lit(":"), F.length("payload").cast("string"))))
    first = keyed.where("_key is not null").groupBy("_key").agg(F.max("page_id").alias("_first"), F.count("*").alias("_times"))
    first = saved(first.where("_times > 1 and _first is not null").drop("_times"), "repeats")
    # both sides are tables: a payload that a third of all pages have is split by the join itself
    again = keyed.join(first, "_key", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))
    writing = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[str] = []
        size = 0

        def stretch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([CLOSE.join(held)], pa.string())], ["value"])

        for batch in batches:
            for k in range(len(batch)):
                page, url, payload, refers = (batch.column(c)[k].as_py() for c in range(4))
                held += transaction(f"{writing}:{task}:{number}", page, url, payload, refers)
                number += 1
                size += len(payload) + 1000
                if size >= STRETCH:
                    yield stretch()
                    held, size = [], 0
        if held:
            yield stretch()

    records = again.mapInArrow(run, "value string")
    records.write.option("lineSep", CLOSE).option("compression", "gzip").option("maxRecordsPerFile", FILE_STRETCHES).text(out)


def unpacked(data: memoryview) -> Iterator[bytes]:
    """The bytes of an archive in parts of bounded size; gzip members are unpacked one after another."""
    if bytes(data[:2]) != b"\x1f\x8b":
        for at in range(0, len(data), PACKED):
            yield bytes(data[at : at + PACKED])
        return
    at, z = 0, zlib.decompressobj(31)
    while at < len(data):
        given = data[at : at + PACKED]
        at += len(given)
        part = z.decompress(given, 4 * PACKED)
        while part:
            yield part
            part = z.decompress(z.unconsumed_tail, 4 * PACKED) if z.unconsumed_tail else b""
        if z.eof:  # the next member begins where this one has ended
            at -= len(z.unused_data)
            z = zlib.decompressobj(31)


def records_of(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive's bytes; one record is held at a time."""
    parts, held, ahead = unpacked(memoryview(data)), bytearray(), 0

    def fill(n: int) -> bool:
        """Whether there are n bytes."""
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while fill(1):
        end = held.find(b"\r\n\r\n")
        while end < 0:
            ahead = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("an archive ends within a record's head")
            end = held.find(b"\r\n\r\n", ahead)
        lines = held[:end].decode("utf-8", "replace").split(LINE)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one has to begin")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        n = int(fields["content-length"])
        fill(end + 4 + n + 4)
        yield fields, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n + 4]


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in a folder, a row each, with payload (null unless payloads), its size and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in records_of(memoryview(content.as_buffer())):
                    kind = f.get("warc-type")
                    web = kind in ("request", "response", "revisit")
                    head, _, payload = block.partition(b"\r\n\r\n") if web else (block, b"", None)
                    sha1 = hashlib.sha1(payload).hexdigest() if kind == "response" else None
                    text = head.decode("utf-8", "replace")
                    rows.append((f.get("warc-record-id"), f.get("warc-concurrent-to"), kind, f.get("warc-target-uri"), int(f["x-capture"]) if "x-capture" in f else None, f.get("x-refers-to-capture"), f.get("warc-payload-digest"), payload if payloads and kind == "response" else None, None if payload is None else len(payload), sha1, text))
                    size += len(block) if payloads else 1000
                    if size >= STRETCH:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assembled(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture, uri, response, request, metadata.

    A record belongs to the identifier it is concurrent to, or else to its own. A transaction has as
    many records as were written of it; a missing kind is null.
    """
    of = lambda kinds, what: F.first(F.when(F.col("kind").isin(kinds), what), ignorenulls=True)
    return (
        records.withColumn("transaction", F.coalesce("concurrent_to", "id"))
        .groupBy("transaction")
        .agg(
            F.max("capture").alias("capture"),
            F.max("uri").alias("uri"),
            of(["response", "revisit"], F.struct("kind", "payload", "payload_bytes", "payload_digest", F.col("refers_to").cast("long").alias("refers_to"), "declared_digest")).alias("response"),
            of(["request"], F.struct("id", "block")).alias("request"),
            of(["metadata"], F.struct("id", "block")).alias("metadata"),
        )
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    captures = assembled(read_warc(spark, out, payloads=False))
    revisit = F.col("response.kind") == "revisit"
    about = F.col("metadata.block")
    return captures.select(
        F.col("capture").alias("page_id"),
        # a revisit has no payload of its own: its metadata record tells size and digest of the full one
        F.when(revisit, F.regexp_extract(about, r"payload-bytes: (\d+)", 1).cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_extract(about, r"payload-sha1: ([0-9a-f]+)", 1)).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("response.refers_to").alias("refers_to"),
    )


#: Revisits by the payload itself.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS first_id FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM d)
SELECT page_id, cast(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
FROM r
"""
