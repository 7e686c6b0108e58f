"""WARC archives: write captures, read records, assemble transactions.

Writing gives each page a request, a response and a metadata record; request and
metadata name the response in WARC-Concurrent-To. Of equal payloads of at least
``least`` bytes one is stored, the others become revisit records that refer to it.
The record text is built by Spark's own functions and goes out through Spark's
text writer, one gzip stream a file, so a lost task is written again as a whole.
(The writer ends every row with a separator, hence gzip members for single records
are not possible that way.)

Reading streams each file through gzip and yields one row for each record. Assembly
joins request, response and metadata records on the response's id into one nested
row for each capture.

Defined cases: a null payload is an empty one; a null URL is written as an empty
target; repeated rows are captures of their own; the first of equal payloads is the
one with the smallest page id, and all rows with that id are responses; payloads
below ``least`` bytes are always responses; payloads with equal bytes but only null
ids are responses. Line breaks in a URL are percent-encoded. Extra columns are
ignored.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.storage import new_folder

VERSION = "WARC/1.1"
END = "\r\n"
# The record formats named in the standard.
HTTP_REQUEST = "application/http;msgtype=request"
HTTP_RESPONSE = "application/http;msgtype=response"
FIELDS = "application/warc-fields"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(kind: str) -> Column:
    h = F.md5(F.concat(F.lit(kind), F.col("capture")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column, end: str = END + END) -> Column:
    """One record; a header with a null value is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(END)) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return F.concat(F.lit(VERSION + END), *[F.coalesce(x, F.lit("")) for x in lines], length, F.lit(END), block, F.lit(end))


def write(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = 100) -> str:
    """Write the captures to ``folder`` (a new shared one by default) and return it."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("string").alias("page_id"), F.col(page_id).alias("order"), body.alias("body"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("bytes"),
    )
    firsts = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("order").alias("first"))
    rows = rows.join(firsts, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("order").eqNullSafe(F.col("first")))
    rows = rows.withColumn("capture", F.concat_ws(":", F.lit("capture"), "page_id", F.monotonically_increasing_id()))
    host = F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    target, at = ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))
    get = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END + END))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn("q")), at, target, ("WARC-Concurrent-To", _urn("r")), ("Content-Type", F.lit(HTTP_REQUEST))], get)
    # The id of the page to which a revisit refers is known, the id of its record is not: that page may be in another file.
    response = _record(
        [
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", _urn("r")), at, target, digest,
            ("WARC-Profile", F.when(F.col("revisit"), SAME_PAYLOAD)), ("X-Refers-To-Page", F.when(F.col("revisit"), F.col("first").cast("string"))),
            ("Content-Type", F.lit(HTTP_RESPONSE)),
        ],
        F.concat(answer, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("body"))),
    )
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id"), F.lit(END)), F.lit("")), F.lit("charset: utf-8"), F.lit(END))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn("m")), at, target, ("WARC-Concurrent-To", _urn("r")), ("Content-Type", F.lit(FIELDS))], about, END)
    # The writer adds the last line break of each row.
    rows.select(F.concat(request, response, metadata).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(folder)
    return folder


class _Counting:
    """Bytes of a gzip file, one line or block at a time."""

    def __init__(self, data: bytes) -> None:
        self.file = gzip.open(pa.BufferReader(data)) if data[:2] == b"\x1f\x8b" else pa.BufferReader(data)
        import io

        self.file = io.BufferedReader(self.file, 1 << 18) if not isinstance(self.file, gzip.GzipFile) else self.file

    def line(self) -> bytes:
        return self.file.readline()

    def block(self, n: int) -> bytes:
        got = self.file.read(n)
        if len(got) != n:
            raise ValueError(f"record ends after {len(got)} of {n} bytes")
        return got


def records_of(data: bytes):
    """(WARC headers, HTTP or field headers, payload) of each record in a file."""
    file = _Counting(data)

    def headers() -> dict[str, str]:
        found: dict[str, str] = {}
        while (line := file.line()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            found[name.strip().lower()] = value.strip()
        return found

    while first := file.line():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {first[:40]!r}")
        outer = headers()
        block = file.block(int(outer["content-length"]))
        inner: dict[str, str] = {}
        if outer.get("content-type", "").startswith("application/http"):
            head, _, block = block.partition(b"\r\n\r\n")
            for line in head.split(b"\r\n")[1:]:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                inner[name.strip().lower()] = value.strip()
        elif outer.get("content-type") == FIELDS:
            for line in block.split(b"\r\n"):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                if name:
                    inner[name.strip().lower()] = value.strip()
        yield outer, inner, block


RECORD = "type string, record_id string, concurrent_to string, target_uri string, date string, refers_to_page string, stated_digest string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"


def read(spark, folder: str, payload: bool = True) -> DataFrame:
    """One row for each record. Without ``payload`` only its size and digest are kept.

    A file is one task's work and is decompressed as a stream.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                out: list[dict] = []
                held = 0
                for outer, inner, block in records_of(data.as_buffer().to_pybytes()):
                    out.append(
                        {
                            "type": outer.get("warc-type"), "record_id": outer.get("warc-record-id"), "concurrent_to": outer.get("warc-concurrent-to"),
                            "target_uri": outer.get("warc-target-uri"), "date": outer.get("warc-date"), "refers_to_page": outer.get("x-refers-to-page"),
                            "stated_digest": outer.get("warc-payload-digest", "").removeprefix("sha256:") or None, "fields": list(inner.items()),
                            "payload_bytes": len(block), "payload_digest": hashlib.sha256(block).hexdigest(), "payload": block if payload else None,
                        }
                    )
                    held += len(block) if payload else 500
                    if held > 8 << 20 or len(out) >= 5000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    text = pa.string()
    schema = pa.schema([(n, text) for n in ("type", "record_id", "concurrent_to", "target_uri", "date", "refers_to_page", "stated_digest")] + [("fields", pa.map_(text, text)), ("payload_bytes", pa.int64()), ("payload_digest", text), ("payload", pa.binary())])
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture_id``, ``response``, and ``request`` and ``metadata`` or null.

    Requests and metadata that name no response at hand are left out; several of one
    kind with the same response give a row each. Records are told apart by their id.
    """

    def of(kind: str) -> DataFrame:
        picked = records.where(F.col("type") == kind)
        return picked.select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target_uri", "date", "fields").alias(kind))

    answers = records.where(F.col("type").isin("response", "revisit"))
    answers = answers.select(F.col("record_id").alias("capture_id"), F.struct("type", "target_uri", "date", "refers_to_page", "stated_digest", "fields", "payload_bytes", "payload_digest", "payload").alias("response"))
    return answers.join(of("request"), "capture_id", "left").join(of("metadata"), "capture_id", "left")
