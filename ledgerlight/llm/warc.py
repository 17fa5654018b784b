"""WARC archives with revisit resolution.

Only headers (page, address, payload digest and length) are shuffled by payload digest; each digest's
largest page is its response and the others revisit it. The decisions are joined back to the
pages by page and digest, so no key holds more payloads than one page has. The archives are written by
Spark's own writer to any file system that Spark knows: one record after the other, gzip-compressed
files of a bounded number of records, each file a valid WARC 1.1 file under gzip (one stream a file: Spark's writers have no members). Reading streams each file as pieces between
version lines and follows Content-Length, so a version line inside a payload ends nothing, and a task holds a batch of records, never a file.

Defined results: a null payload is empty and counts as equal to other empty ones; a null page id is smaller than all others and has no
X-Page-Id header; rows with the same page and payload are all responses if they are the largest; an empty table gives no files and no rows; only the id, address and payload columns are read,
so other names cannot clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload in a file, on average, before compression.
FILE_BYTES = 16 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of a SHA-1 digest, bare: five hex digits at a time are four base-32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def resolve(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """heads: page_id, url, payload_digest, payload_bytes -> one row for each different (page_id, payload_digest), with record_type, refers_to, refers_url."""
    firsts = heads.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("top")).select("payload_digest", F.col("top.page_id").alias("top_id"), F.col("top.url").alias("top_url"))
    each = heads.groupBy("page_id", "payload_digest").agg(F.max("url").alias("url"), F.max("payload_bytes").alias("payload_bytes"))
    revisit = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("top_id"))
    return each.join(firsts, "payload_digest", "left").select(
        "page_id", "payload_digest", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("top_id")).alias("refers_to"), F.when(revisit, F.col("top_url")).alias("refers_url"),
    )


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = DATE) -> None:
    """Writes the archives of all pages under path."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "%0A").alias("url"), payload.alias("payload"), base32_sha1(payload.cast("binary")).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    heads = src.select("page_id", "url", "payload_digest", "payload_bytes")
    mean = heads.agg(F.avg("payload_bytes")).first()[0] or 1
    decided = resolve(heads, least_bytes).select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "record_type", "refers_to", "refers_url")
    rows = src.join(decided, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")))
    crlf, revisit = F.lit("\r\n"), F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), crlf)
    maybe = lambda test, value: F.when(test, value).otherwise(F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes")), crlf)
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _uuid(F.col("record_type"), F.col("page_id"), F.col("payload_digest"))), F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), maybe(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id"))),
        maybe(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To-Date: {date}\r\n"), line("WARC-Refers-To", _uuid(F.lit("response"), F.col("refers_to"), F.col("payload_digest"))), line("WARC-Refers-To-Target-URI", F.col("refers_url")), maybe(F.col("refers_to").isNotNull(), line("X-Refers-To-Page-Id", F.col("refers_to"))))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))), crlf,
    )
    record = F.concat(head, http, maybe(~revisit, F.col("payload")), crlf)  # the writer's line end is the second of the two that close a record
    rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", max(1, int(file_bytes / max(1, mean)))).option("compression", "gzip").text(path)


def records(data: bytes):
    """(headers in lower case, block) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not re.fullmatch(r"WARC/1\.\d", lines[0]):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = end + 4
        at = block + int(head["content-length"])
        yield head, data[block:at]
        at += 4


_VERSION = "WARC/1.1\r\n"
_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def _row(record: bytes, start: int) -> tuple:
    """The values of one whole record (without its version line); its payload is checked against digest and length."""
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in record[: start - 4].decode("utf-8").split("\r\n"))}
    http, _, payload = record[start:-4].partition(b"\r\n\r\n")
    digest, length = head["warc-payload-digest"].removeprefix("sha1:"), int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    response = head["warc-type"] == "response"
    if response and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != length):
        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
    ids = [head.get("x-page-id"), head.get("x-refers-to-page-id")]
    return ids[0] and int(ids[0]), length, digest, head["warc-type"], ids[1] and int(ids[1]), head["warc-target-uri"], payload if response else None


def _parse(batches):
    """Rows of the records of files, which come one after the other as the pieces between their version lines."""
    file, parts, have, start, size = None, [], 0, 0, 0  # the open record: its parts and their bytes, where its block starts, its whole length (0: none is open)
    for b in batches:
        out: list[tuple] = []
        for name, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data = piece.as_buffer().to_pybytes()
            if name != file:
                if size or data:
                    raise ValueError(f"{file if size else name}: a record is cut off")
                file = name
                continue
            if size:  # a version line inside a payload
                parts += [_VERSION.encode(), data]
                have += len(_VERSION) + len(data)
            else:
                parts, have, start = [data], len(data), data.index(b"\r\n\r\n") + 4
                size = start + int(re.search(rb"(?im)^content-length: *(\d+)", data[:start])[1]) + 4
            if have > size:
                raise ValueError(f"{file}: a record is longer than it says")
            if have == size:
                out.append(_row(b"".join(parts), start))
                parts, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)
    if size:
        raise ValueError(f"{file}: a record is cut off")


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row for each record of the archives under path; whole payloads of responses if asked for."""
    files = spark.read.option("pathGlobFilter", "part-*").option("lineSep", _VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary"))
    keep = _NAMES[: 7 if payloads else 6]

    def run(batches):
        for b in _parse(batches):
            yield b.select(keep)

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the archives of pages into the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)
