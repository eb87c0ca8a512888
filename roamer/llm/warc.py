"""WARC archives: written from pages, read back and assembled into captures.

Writing makes three records a row: the response (or a revisit, which has
no payload), its request and its metadata; the latter two name the former in
WARC-Concurrent-To. Of rows with equal payloads of at least ``least`` bytes
the one with the largest id is the response and the others revisit it. A filter
passes the rows whose digest is there once straight through; of the others only
digests, ids and urls are shuffled, and one payload for each digest and task.

Archives are gzip files of WARC/1.1 records in the shared folder. How many
records a file holds follows from the mean size of a page (``FILE_BYTES``), so
that a file fits a task's memory. They are written and read through Spark's
sources only.

Reading parses records by Content-Length, one at a time; assembling joins
request and metadata records to their response through the concurrent-to
identifiers and emits one nested row for each response or revisit. Payload
length and digest of a response are computed from the payload that was read; for
a revisit they are those its records state.

Control characters and spaces of a url are percent-encoded in headers; the
metadata record has the url itself.

Cases: null html is an empty payload; a null url is an empty one; rows that
repeat are captures of their own: one is the response, the others revisit it;
a null id is smaller than all others; a response without request or
metadata has nulls there; requests and metadata without their response are left
out; empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.store import dropped, repeat_filter, repeat_words, repeated, shared_path, short_batches, written

#: Bytes of records in a file, by the mean size of a page, and the most records of a file.
FILE_BYTES, RECORDS = 48 << 20, 3000
#: Line ends, base-32 alphabet, profile of a revisit.
EOL = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "type string, id string, concurrent_to string, refers_to string, uri string, date string, digest string, block_bytes long, payload_bytes long, payload binary, fields map<string,string>"


def base32_sha1(data: Column) -> Column:
    """Upper-case base-32 SHA-1 of a binary column: four digits out of each 20 bits."""
    h = F.sha1(data)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _encoded(url: Column) -> Column:
    """A url with control characters and spaces percent-encoded."""
    each = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[\x00-\x20\x7f]$"), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), F.array_join(each, "")).otherwise(url)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record but for its closing line ends; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(EOL, F.lit("WARC/1.1"), *lines, size), F.lit(EOL * 2), block)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the archives of all pages to ``path``."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    facts = written(rows.select("id", "url", "digest", "size"), "warc-facts")
    n, size = facts.agg(F.count(F.lit(1)), F.sum("size")).first()
    words = repeat_words(n)
    tables = repeat_filter(facts, "digest", words)
    seen = repeated(rows, F.col("digest"), tables, words)
    again = repeated(facts, F.col("digest"), tables, words).where(F.col("maybe") & (F.col("size") >= least))
    # Rows that repeat in id, url and payload are told apart by a number; the first of the last one is the response.
    each = written(again.groupBy("digest", "size", "id", "url").agg(F.count(F.lit(1)).alias("rows")), "warc-again")
    first = written(each.groupBy("digest", "size").agg(F.max(F.struct("id", "url")).alias("first")), "warc-first")
    payloads = seen.where(F.col("maybe") & (F.col("size") >= least)).groupBy("digest", "size").agg(F.first("html").alias("html"))
    none = [F.lit(None).cast(first.schema["first"].dataType["id"].dataType).alias("to"), F.lit(None).cast("string").alias("to_url")]
    alone = seen.where(~F.col("maybe") | (F.col("size") < least))
    # Of payloads below the least size, rows that repeat get numbers at random.
    number = F.when(F.col("size") < least, F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    alone = alone.select("id", "url", "digest", "size", "html", number.alias("number"), *none)
    answers = payloads.join(first, ["digest", "size"]).select("first.id", "first.url", "digest", "size", "html", F.lit(0).cast("long").alias("number"), *none)
    later = each.join(first, ["digest", "size"]).withColumn("is_first", F.struct("id", "url").eqNullSafe(F.col("first")))
    later = later.where(~F.col("is_first") | (F.col("rows") > 1)).withColumn("number", F.explode(F.sequence(F.when(F.col("is_first"), 1).otherwise(0).cast("long"), F.col("rows") - 1)))
    later = later.select("id", "url", "digest", "size", F.lit(None).cast("string").alias("html"), "number", F.col("first.id").alias("to"), F.col("first.url").alias("to_url"))
    all_ = alone.unionByName(answers).unionByName(later)
    capture = lambda i, u, k: _uuid(F.lit("capture"), i, u, F.col("digest"), k)
    is_revisit = F.col("html").isNull()
    all_ = all_.withColumn("capture", capture(F.col("id"), F.col("url"), F.col("number"))).withColumn("uri", _encoded(F.col("url")))
    common = [("WARC-Target-URI", F.col("uri")), ("WARC-Date", F.lit(date))]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(EOL * 2))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    answer = F.when(~is_revisit, _record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("capture")), *common, digest, http], F.concat(head, F.col("html")))).otherwise(
        _record([("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", F.col("capture")), *common, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", capture(F.col("to"), F.col("to_url"), F.lit(0).cast("long"))), digest, http], head)
    )
    place = F.regexp_extract("uri", r"^[a-z]+://[^/?#]*([^#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place)), F.lit(f" HTTP/1.1{EOL}Host: "), F.regexp_extract("uri", r"^[a-z]+://([^/?#]*)", 1), F.lit(EOL * 2))
    asked = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid(F.lit("request"), F.col("capture"))), *common, ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", F.lit("application/http; msgtype=request"))], get)
    text = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    fields = [text("page-id", F.col("id")), text("payload-bytes", F.col("size")), text("refers-to-page", F.col("to")), F.when(F.col("uri") != F.col("url"), text("url-base64", F.base64(F.col("url").cast("binary")))), F.lit("")]
    about = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid(F.lit("metadata"), F.col("capture"))), *common, ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", F.lit("application/warc-fields"))], F.concat_ws(EOL, *fields))
    records = all_.select(F.explode(F.array(answer, asked, about)).alias("value"))
    captures = FILE_BYTES // max(1, (size or 0) // max(n, 1) + 1000)
    records.write.options(compression="gzip", lineSep=EOL * 2, maxRecordsPerFile=max(3, min(RECORDS, 3 * captures))).text(path)
    dropped(facts, each, first)


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive (plain, or gzip members), by their Content-Length, one at a time."""
    file = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        file = io.BufferedReader(gzip.GzipFile(fileobj=file), 1 << 18)
    while line := file.readline():
        if not line.startswith(b"WARC/"):  # line ends between records
            if line.strip():
                raise ValueError("a record doesn't begin with its version")
            continue
        head: dict[str, str] = {}
        while (line := file.readline()) and line != b"\r\n":
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        if not head.get("content-length", "").isdigit():
            raise ValueError(f"record {head.get('warc-record-id')} has no length")
        size = int(head["content-length"])
        block = file.read(size)
        if len(block) < size:
            raise ValueError(f"record {head.get('warc-record-id')} ends early")
        kind = head.get("warc-type")
        out = {"type": kind, "id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "block_bytes": size}
        out["digest"] = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        out |= {"payload": None, "payload_bytes": None, "fields": None}
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if out["digest"] not in (None, digest):
                raise ValueError(f"record {out['id']} has another payload than its digest says")
            out |= {"payload": payload, "payload_bytes": len(payload), "digest": digest}
        elif head.get("content-type") == "application/warc-fields":
            out["fields"] = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(EOL)) if k.strip()]
        yield out


_SCHEMA = pa.schema(
    [(n, pa.string()) for n in ("type", "id", "concurrent_to", "refers_to", "uri", "date", "digest")] + [("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))]
)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            some: list[dict] = []
            held = 0
            for r in parse(content.as_py()):
                some.append(r)
                held += r["block_bytes"]
                if len(some) == 500 or held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(some, schema=_SCHEMA)
                    some, held = [], 0
            if some:
                yield pa.RecordBatch.from_pylist(some, schema=_SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path`` (columns ``RECORD``)."""
    short_batches(spark)
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.where("length > 0").select("content").mapInArrow(_parsed, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: capture_id, uri, url, date, answer, request, metadata.

    Request and metadata records are narrow and joined first; payloads are shuffled once, to their capture.
    """
    said = records.where("type in ('request', 'metadata') and concurrent_to is not null").groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.min(F.when(F.col("type") == "request", F.struct("id", "uri", "block_bytes"))).alias("request"),
        F.min_by(F.struct("id", "fields"), F.when(F.col("type") == "metadata", F.col("id"))).alias("metadata"),
    )
    answers = records.where("type in ('response', 'revisit')").select(F.col("id").alias("capture_id"), "uri", "date", "type", "digest", "payload_bytes", "payload", "refers_to")
    whole = answers.join(said, "capture_id", "left")
    url = F.coalesce(F.unbase64(F.col("metadata.fields")["url-base64"]).cast("string"), "uri")
    answer = F.struct("type", "digest", "payload_bytes", "payload", "refers_to")  # after the join, so that columns nobody asks for aren't shuffled
    return whole.select("capture_id", "uri", url.alias("url"), "date", answer.alias("answer"), "request", F.when(F.col("metadata.id").isNotNull(), F.col("metadata")).alias("metadata"))


def round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write the pages' archives, read and assemble them: one nested row per capture."""
    path = path or shared_path(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, html_col, least)
    return assemble(read(pages.sparkSession, path))


def summary(captures: DataFrame, id_col: str = "page_id", kind: str = "long") -> DataFrame:
    """id (cast to ``kind``), payload_bytes, payload_digest, record_type and refers_to of each capture."""
    field = lambda n, kind="long": F.col("metadata.fields")[n].cast(kind)
    return captures.select(
        field("page-id", kind).alias(id_col),
        F.coalesce("answer.payload_bytes", field("payload-bytes")).alias("payload_bytes"),
        F.col("answer.digest").alias("payload_digest"),
        F.col("answer.type").alias("record_type"),
        field("refers-to-page", kind).alias("refers_to"),
    )
