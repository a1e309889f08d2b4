"""WARC archives with revisit records.

Only headers (page, url, payload digest, length) are shuffled by payload digest: of the pages with equal payloads, the
one with the largest page_id is kept as response and all others become revisit records that refer to it. The payloads
of the responses then join their headers by page, and the archives are written with fresh headers.

A record ends with CR LF CR LF, which is the line separator of Spark's text writer here, so its files are WARC files,
written under its commit protocol. Readers parse by Content-Length alone; payloads may hold anything.

Defined cases: a null html is an empty payload; empty payloads are equal to each other like any others; rows that
repeat the largest page_id are all responses; a null page_id sorts first and is written as page 'null'; a url's line
breaks become spaces; an empty table writes an empty archive. Payloads smaller than least_bytes never become revisits.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import shared_path, written

#: fixed values of the two formats
BASE32HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32_sha1(raw: Column) -> Column:
    """SHA-1 in upper-case base32: each five hex digits are four of base 32."""
    h = F.sha1(raw)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), BASE32HEX, BASE32)


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_digest, payload_bytes of each page."""
    raw = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select("page_id", "url", base32_sha1(raw).alias("payload_digest"), F.octet_length(raw).cast("long").alias("payload_bytes"))


def resolve(head: DataFrame, least_bytes: int = 0) -> DataFrame:
    """head with record_type, refers_to and refers_url.

    The kept page of each digest is found by partial sums on the map side. The join has the length as a second key, so
    both of its sides are dealt out by its own exchanges and a digest that holds much of the table is split.
    """
    kept = head.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(
        F.max(F.struct("page_id", "url")).alias("kept"), F.max("payload_bytes").alias("payload_bytes"), F.count(F.lit(1)).alias("n")
    )
    kept = kept.filter("n > 1").drop("n")
    df = head.join(kept, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept.page_id"))
    return df.select(
        "page_id",
        "url",
        "payload_digest",
        "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("kept.page_id")).alias("refers_to"),
        F.when(revisit, F.col("kept.url")).alias("refers_url"),
    )


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write(pages: DataFrame, resolved: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write the archive files below path (gzip). Revisits carry the response's HTTP header and no payload."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " ")
    body = pages.select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    body = body.withColumn("_digest", base32_sha1(F.encode(F.col("html"), "UTF-8")))
    cols = ["page_id", "url", "payload_digest", "payload_bytes"]
    key = resolved.filter("record_type = 'response'").select(*cols).distinct()
    kept = body.join(key, key.page_id.eqNullSafe(body._id) & key.url.eqNullSafe(body._url) & (key.payload_digest == body._digest))
    records = kept.select(*cols, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"), "html").unionByName(
        resolved.filter("record_type = 'revisit'").withColumn("html", F.lit(""))
    )
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", flat(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"))), line("WARC-Refers-To-Target-URI", flat(F.col("refers_url"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length("html")).cast("string")),
        F.lit(CRLF),
    )
    # each task writes a file; Spark sizes the partitions of the join
    out = records.select(F.concat(head, http, F.col("html")).alias("value"))
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def parse(raw: bytes) -> Iterator[tuple]:
    """The records of one archive, as rows of READ. A broken record or digest raises ValueError."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v for k, v in HEADER.findall(raw, at, end + 2)}
        n = int(head[b"content-length"])
        block = raw[end + 4 : end + 4 + n]
        if len(block) != n:
            raise ValueError("the archive ends inside a record")
        http, _, payload = block.partition(b"\r\n\r\n")
        said = {k.lower(): v for k, v in HEADER.findall(http + b"\r\n")}
        kind = head[b"warc-type"].decode()
        digest = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
        if kind == "response" and _b32(payload) != digest:
            raise ValueError(f"the payload at byte {at} doesn't match its digest")
        yield _page(head[b"warc-record-id"]), head[b"warc-target-uri"].decode(), kind, digest, int(said[b"content-length"]), _page(head.get(b"warc-refers-to")), payload if kind == "response" else None
        at = end + 4 + n + 4


def _b32(payload: bytes) -> str:
    import base64

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page(urn: bytes | None) -> int | None:
    name = (urn or b"<urn:x-page:null>")[12:-1]
    return None if name == b"null" else int(name)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records below path, as rows of READ; without payloads that column is null."""

    def rows(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                raw = zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else content
                found = list(parse(raw))
                if found:
                    cols = [list(c) for c in zip(*found, strict=True)]
                    if not payloads:
                        cols[6] = [None] * len(found)
                    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(rows, READ)


def with_payload(records: DataFrame) -> DataFrame:
    """Revisits given the payload of the response they refer to."""
    first = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("first_payload")).dropDuplicates(["refers_to", "payload_digest"])
    return records.join(first, ["refers_to", "payload_digest"], "left").withColumn("payload", F.coalesce("payload", "first_payload")).drop("first_payload")


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as deduplicated archives and read them back (without payloads)."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    resolved = written(resolve(headers(pages), least_bytes), "warc-headers")
    write(pages, resolved, path)
    return read(spark, path, payloads=False)
