"""WARC archives: written from pages with revisit records, read as records, assembled into captures.

**Writing.**  Every page becomes three records that name each other: the request, the
response and a metadata record that carries the page's id; request and metadata hold
``WARC-Concurrent-To`` with the response's record id.  Of pages with equal payloads of
``min_revisit`` bytes or more one is a response and the others are revisits of it.  The
records of a page are lines of Spark's text writer whose line separator is the two line
ends that close a record, so archives of any size go to any file system that Spark can
write, a task at a time.

**Reading.**  Archives are split at ``CRLF WARC/1.`` by Spark's text reader, so a task
holds one record and not one file, and compressed archives (one gzip member a record, or
one for all) are unpacked on the way.  A payload may hold the separator itself: a record
that is shorter than its ``Content-Length`` goes on in what follows.

**Assembly.**  Records are joined through their concurrent-to identifiers, in whichever
of two records these stand, into one nested row a capture.
"""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.staging import delete, drop_staged, shared_dir, stage

MIN_REVISIT = 1000
#: A record's header is no longer than this; what goes on without an end is no record.
HEADER_BYTES = 1 << 20
BATCH_BYTES = 4 << 20

# Fixed values of the format.
SEPARATOR = "\r\nWARC/1."
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "warc_type string, record_id string, warc_date string, target_uri string, content_type string, concurrent_to array<string>, refers_to string, "
    "headers map<string,string>, http_head string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string, truncated boolean, archive string"
)
_ARROW = pa.schema([
    ("warc_type", pa.string()), ("record_id", pa.string()), ("warc_date", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()),
    ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("http_head", pa.string()),
    ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("truncated", pa.bool_()), ("archive", pa.string()),
])


# ---------------------------------------------------------------- writing


def _record_id(kind: str) -> Column:
    """A record id that the row's key, url and payload determine."""
    digest = F.md5(F.concat_ws("\n", F.lit(kind), F.col("row_key").cast("string"), F.col("page_id").cast("string"), F.col("url"), F.col("digest")))
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _uri(url: Column) -> Column:
    """A url as a header can hold it: blanks and control characters as percent codes."""
    code = lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), F.array_join(F.transform(F.split(url, ""), code), "")).otherwise(url)


def _lines(*parts: Column | str) -> Column:
    """Header lines; a null one is left out."""
    return F.concat_ws("\r\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _record(kind: Column, record_id: Column, date: str, content_type: str, block: Column, *more: Column) -> Column:
    lines = [F.lit("WARC/1.1"), _field("WARC-Type", kind), _field("WARC-Record-ID", record_id), _field("WARC-Date", F.lit(date)), *more]
    lines += [_field("Content-Type", F.lit(content_type)), _field("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(_lines(*lines), F.lit(RECORD_END), block)


def _keyed(pages: DataFrame) -> DataFrame:
    """Staged pages with the digest, the size and the record id of each row."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select("page_id", _uri(F.col("url").cast("string")).alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("row_key"))
    keyed = keyed.withColumns({"digest": F.sha1("html"), "equal_to": F.sha2("html", 256), "n_bytes": F.octet_length("html").cast("long")})
    return stage(keyed.withColumn("record_id", _record_id("response")), "pages", compression="zstd")


def marked_revisits(keyed: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``keyed`` beside ``to``: id, address and record of the response that a revisit repeats, null for responses.

    Of equal payloads of ``min_revisit`` bytes or more the row with the largest page id is
    the response (of repeated ids that with the larger url, then any one; a missing id is
    the smallest).  Payloads travel once, by the row's key; what meets by the payload, and
    may hold a third of all rows, is ids and digests alone.
    """
    light = keyed.filter(F.col("n_bytes") >= min_revisit).select("equal_to", "n_bytes", "row_key", F.struct("page_id", "url", "record_id").alias("own"))
    first = light.groupBy("equal_to", "n_bytes").agg(F.max("own").alias("to"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    revisits = light.join(first, ["equal_to", "n_bytes"]).filter("own.record_id != to.record_id").select("row_key", "to")
    return keyed.join(revisits, "row_key", "left")


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str | None = None, compression: str = "gzip") -> None:
    """Write ``page_id, url, html`` as archives below ``path``: request, response or revisit, and metadata record of each page.

    A null html is an empty payload; a null url gives records without an address, a null
    page id a metadata record without the field; repeated rows are captures of their own;
    other columns do not matter.  ``date`` is the capture's time (ISO 8601; now, if not given).
    """
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    keyed = _keyed(pages)
    rows = marked_revisits(keyed, min_revisit)
    uri, revisit = _field("WARC-Target-URI", F.col("url")), F.col("to").isNotNull()
    host, place = F.try_parse_url(F.col("url"), F.lit("HOST")), F.try_parse_url(F.col("url"), F.lit("PATH"))
    http = F.lit("application/http;msgtype=")
    head = F.concat(_lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", _field("Content-Length", F.col("n_bytes").cast("string"))), F.lit(RECORD_END))
    main = _record(
        F.when(revisit, "revisit").otherwise("response"), F.col("record_id"), date, "application/http;msgtype=response",
        F.when(revisit, head).otherwise(F.concat(head, F.col("html"))), uri, _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, _field("WARC-Profile", F.lit(REVISIT_PROFILE))), _field("WARC-Refers-To", F.col("to.record_id")), _field("WARC-Refers-To-Target-URI", F.col("to.url")),
    )
    beside = _field("WARC-Concurrent-To", F.col("record_id"))
    asked = F.concat(_lines(F.concat(F.lit("GET "), F.coalesce(F.nullif(place, F.lit("")), F.lit("/")), F.lit(" HTTP/1.1")), _field("Host", host)), F.lit(RECORD_END))
    request = _record(F.lit("request"), _record_id("request"), date, "application/http;msgtype=request", asked, uri, beside)
    about = F.concat(_lines("software: graphloom", _field("page-id", F.col("page_id").cast("string"))), F.lit("\r\n"))
    metadata = _record(F.lit("metadata"), _record_id("metadata"), date, "application/warc-fields", about, uri, beside)
    records = rows.select(F.explode(F.array(request, main, metadata)).alias("value"))
    records.write.text(path, compression=compression, lineSep=RECORD_END)
    drop_staged(keyed)


# ---------------------------------------------------------------- reading


def _named_lines(text: bytes) -> list[tuple[str, str]]:
    """``name: value`` lines, names in lower case; a line that begins with a blank goes on the one before."""
    found: list[tuple[str, str]] = []
    for line in text.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            found.append((name.strip().lower(), value.strip()))
    return found


def _bare_digest(value: str | None) -> str | None:
    """A labelled digest as bare lower-case hex, whether written in hex or in base 32."""
    value = (value or "").rpartition(":")[2]
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except binascii.Error:
            return value.lower()
    return value.lower() or None


def _length(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() and len(value) < 19 else None


def _record_row(head: bytes, block: bytes, archive: str, truncated: bool) -> dict:
    """One record; the payload of an HTTP message is its body, that of any other record its block."""
    lines = _named_lines(head.partition(b"\r\n")[2])
    named = dict(reversed(lines))
    kind, content_type = (named.get("warc-type") or "").lower() or None, named.get("content-type")
    http_head, payload, fields = None, block, None
    if (content_type or "").lower().replace(" ", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http_head = top.decode("utf-8", "replace")
    elif (content_type or "").lower().startswith("application/warc-fields"):
        fields = list(dict(_named_lines(block)).items())
    n_bytes, digest = len(payload), hashlib.sha1(payload).hexdigest()  # noqa: S324
    if kind == "revisit":  # the payload stands elsewhere: what is known of it is in the headers
        n_bytes = _length(dict(_named_lines((http_head or "").encode())).get("content-length"))
        digest, payload = _bare_digest(named.get("warc-payload-digest")), None
    return {
        "warc_type": kind, "record_id": named.get("warc-record-id"), "warc_date": named.get("warc-date"), "target_uri": named.get("warc-target-uri"),
        "content_type": content_type, "concurrent_to": [v for k, v in lines if k == "warc-concurrent-to"], "refers_to": named.get("warc-refers-to"),
        "headers": list(named.items()), "http_head": http_head, "fields": fields, "payload": payload, "payload_bytes": n_bytes,
        "payload_digest": digest, "truncated": truncated, "archive": archive,
    }


class _Open:
    """What has been read of a record so far."""

    def __init__(self, chunk: bytes):
        self.parts, self.size, self.need = [chunk], len(chunk), None
        self.measure()

    def measure(self) -> None:
        """Learn the record's whole size once its header is complete."""
        if self.need is None:
            whole = b"".join(self.parts)
            end = whole.find(b"\r\n\r\n", 0, HEADER_BYTES)
            if end >= 0:
                self.parts, self.head = [whole], end
                lengths = [_length(v) for k, v in _named_lines(whole[:end].partition(b"\r\n")[2]) if k == "content-length"]
                self.need = end + 4 + (lengths[0] if lengths and lengths[0] is not None else max(0, len(whole) - end - 6))

    def add(self, chunk: bytes) -> None:
        self.parts += [SEPARATOR.encode(), chunk]
        self.size += len(SEPARATOR) + len(chunk)
        self.measure()

    def done(self) -> bool:
        return self.need is not None and self.size >= self.need or self.need is None and self.size > HEADER_BYTES

    def row(self, archive: str) -> dict | None:
        """The record; none if its header has no end."""
        if self.need is None:
            return None
        whole = b"".join(self.parts)
        return _record_row(whole[: self.head], whole[self.head + 4 : self.need], archive, self.size < self.need)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from the chunks of archives, in the order in which they stand there."""
    rows, held, archive, record = [], 0, None, None

    def ended() -> None:
        nonlocal held, record
        if record is not None and (row := record.row(archive)) is not None:
            rows.append(row)
            held += record.size
        record = None

    for batch in batches:
        for chunk, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            chunk = chunk.as_py()
            if name != archive:
                ended()
                archive = name
            if record is not None and not record.done():
                record.add(chunk)
            else:
                ended()
                # only an archive's first record still has what splits the others
                record = _Open(chunk.removeprefix(SEPARATOR[2:].encode()))
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, held = [], 0
    ended()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives that ``path`` names, one row each (``RECORD_SCHEMA``).

    ``payload_bytes`` and ``payload_digest`` (bare hex SHA-1) are of the payload itself, for
    revisits as their headers tell them.  A record that its archive breaks off has
    ``truncated``; a header without an end is no record; a header that lacks its length
    takes what stands up to the next record.  Transfer codings of HTTP are not undone.  An
    unpacked archive over ``spark.sql.files.maxPartitionBytes`` is read by several tasks;
    there a payload that holds the separator must not cross two tasks' parts.
    """
    chunks = spark.read.schema("value string").option("lineSep", SEPARATOR).text(path)
    return chunks.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("archive")).mapInArrow(_records, RECORD_SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """One nested row a capture: ``response`` (or revisit), ``request`` and ``metadata``, met through concurrent-to identifiers.

    The identifier may stand in either record.  Of several requests, or metadata records, of
    a capture that with the smallest record id is taken; those that belong to no capture
    are left out, captures without one have null there.  ``refers_to`` of the response names
    another capture's record.  All columns of ``records`` but the headers are kept.
    """
    nested = F.struct(*[c for c in records.columns if c != "headers"])
    main = records.filter(F.col("warc_type").isin("response", "revisit")).select("record_id", "concurrent_to", nested.alias("response"))
    beside = records.filter(F.col("warc_type").isin("request", "metadata")).select("record_id", "concurrent_to", "warc_type", nested.alias("beside"))
    named = beside.select(F.explode("concurrent_to").alias("capture"), "record_id", "warc_type", "beside")
    naming = main.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("record_id")).join(beside.drop("concurrent_to"), "record_id")
    one = lambda kind: F.min_by(F.when(F.col("warc_type") == kind, F.col("beside")), F.when(F.col("warc_type") == kind, F.col("record_id"))).alias(kind)
    met = named.unionByName(naming).groupBy("capture").agg(one("request"), one("metadata"))
    return main.join(met, F.col("record_id") == F.col("capture"), "left").select("record_id", "response", "request", "metadata")


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and give each page as its capture tells it.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and ``target_uri``;
    page ids are whole numbers.  See :func:`marked_revisits` for repeated and missing ids.
    An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_revisit)
    records = stage(read_archives(spark, path).drop("payload", "headers", "http_head"), "records")
    delete(spark, path)
    page = F.col("metadata.fields")["page-id"].cast("long").alias("page_id")
    told = [F.col(f"response.{c}") for c in ("record_id", "payload_bytes", "payload_digest", "target_uri", "refers_to")]
    rows = stage(captures(records).select(page, F.col("response.warc_type").alias("record_type"), *told), "captures")
    drop_staged(records)
    responses, revisits = rows.filter("record_type = 'response'"), rows.filter("record_type = 'revisit'")
    to = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"))
    revisits = revisits.join(to, "refers_to", "left").withColumn("refers_to", F.col("to_page"))
    both = revisits.unionByName(responses.withColumn("refers_to", F.lit(None).cast("long")), allowMissingColumns=True)
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")
