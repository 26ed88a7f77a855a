"""WARC archives with revisit resolution.

Headers (page id, payload digest, size) are shuffled by digest, never payloads; the smallest page id of a digest is the
original. Archives hold one record per page with fresh headers: ``response`` records carry the payload, ``revisit``
records only refer to it. Pages learn from a broadcast which of them are revisits as long as those are few enough
(``BROADCAST_REVISITS``); beyond that they are joined by id and digest, which shuffles payloads. Each record is a gzip
member of its own, so that any record can be read from its offset alone; files have about ``FILE_BYTES``, or one record.
They are written by Spark's text sink in the shared folder, so any store works, and read back as binary files, record by
record through Content-Length. What was read is kept as a narrow table, and revisits are joined to the originals there.

Defined cases: a null payload is empty; a null URL is written as ``urn:page:<id>``; line breaks in URLs are
percent-encoded; a null id is written without its header and read back as null; repeated rows give repeated records,
all of them responses when they hold the smallest id; an empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_salted, materialize, scratch, table

#: Payloads below this many bytes are always written whole.
LEAST_BYTES = 100
#: Compressed bytes handed to the sink at once, and of a file, about; revisits that are broadcast at most.
PIECE_BYTES, FILE_BYTES, BROADCAST_REVISITS = 1 << 24, 1 << 26, 500_000
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to_id string, record_id string"


def _uuid(of) -> F.Column:
    h = F.md5(of)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record_id(page, digest) -> F.Column:
    return _uuid(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("-")), digest))


def resolve_revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, original): the pages that repeat an earlier payload, from headers (page_id, digest, size)."""
    own = headers.where(F.col("size") >= least_bytes)
    first = own.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "original")
    return join_salted(own, first, "digest", by="page_id").where(~F.col("page_id").eqNullSafe(F.col("original"))).select("page_id", "digest", "original").distinct()


def member(record: bytes) -> bytes:
    """A gzip member without its last byte, which is 0: that is what the sink puts after each piece. The byte is the
    highest of the size, so a record of 16 MB or more is followed by an empty member."""
    out = b""
    for part in (record,) if len(record) < 1 << 24 else (record, b""):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += packer.compress(part) + packer.flush()
    return out[:-1]


def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (one string column) to pieces of whole gzip members, joined by the byte that ``member`` leaves out."""
    held, size = [], 0
    for b in batches:
        for r in b.column(0):
            if size >= PIECE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"\0".join(held)], pa.binary())], names=["value"])
                held, size = [], 0
            held.append(member(r.as_buffer().to_pybytes()))
            size += len(held[-1])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"\0".join(held)], pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, payload: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write a record per row of (page_id, url, payload) below ``path``."""
    own = pages.select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")))), "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce(payload, F.lit("")).alias("body"))
    own = own.withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body").cast("long"))
    headers = materialize(own.select("page_id", "digest", "size"), "headers")
    again = materialize(resolve_revisits(headers, least_bytes), "revisits")
    again = F.broadcast(again) if again.count() <= BROADCAST_REVISITS else again
    p, d, a = own.alias("p"), F.col("p.digest"), again.alias("a")
    rows = p.join(a, F.col("p.page_id").eqNullSafe(F.col("a.page_id")) & (d == F.col("a.digest")), "left")
    is_again = F.col("a.digest").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("p.size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(is_again, http).otherwise(F.concat(http, F.col("p.body")))
    rows = rows.select(is_again.alias("again"), F.col("p.page_id").alias("page_id"), F.col("p.url").alias("url"), d.alias("digest"), F.col("a.original").alias("original"), block.alias("block"))
    c = F.col
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(c("again"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(c("page_id"), c("digest")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), c("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), c("digest"),
        F.when(c("again"), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _record_id(c("original"), c("digest")))).otherwise(""),
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), c("page_id").cast("string")), F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"),
        F.lit("\r\n\r\n"), c("block"), F.lit("\r\n\r\n"),
    )
    packed = rows.select(record.alias("value")).mapInArrow(compress, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_BYTES // PIECE_BYTES).text(path)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive, gzip or plain; holds one record at a time."""
    plain, step = content[:2] != b"\x1f\x8b", 1 << 20
    inflate, at, buf = zlib.decompressobj(31), 0, b""

    def more() -> bool:
        nonlocal at, buf, inflate
        if at >= len(content):
            return False
        piece, at = content[at : at + step], at + step
        if plain:
            buf += piece
            return True
        while piece:
            buf += inflate.decompress(piece)
            piece = inflate.unused_data
            if inflate.eof:  # a further member follows
                inflate = zlib.decompressobj(31)
        return True

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("truncated WARC header")
                return
        lines = buf[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(head["Content-Length"])
        parts, have = [buf], len(buf)
        while have < stop + 4:
            buf = b""
            if not more():
                raise ValueError("truncated WARC block")
            parts.append(buf)
            have += len(buf)
        buf = b"".join(parts)
        yield head, buf[end + 4 : stop]
        buf = buf[stop + 4 :]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path`` with digests and sizes of the payloads as read; a revisit's size is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        kinds = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("record_id", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse_records(content.as_buffer().to_pybytes()):
                    page = head.get("X-Page-Id")
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), None
                    if head["WARC-Type"] == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        size = len(body)
                        if (real := hashlib.sha256(body).hexdigest()) != digest:
                            raise ValueError(f"payload digest {real} differs from its header")
                    rows.append((page and int(page), head["WARC-Type"], size, digest, head.get("WARC-Refers-To"), head["WARC-Record-ID"]))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], type=f.type) for f in kinds], schema=kinds)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, SCHEMA)


def join_revisits(records: DataFrame) -> DataFrame:
    """Each record with its full payload's size and, for revisits, the page that holds the payload."""
    c = F.col
    firsts = records.where("record_type = 'response'").groupBy(c("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("_bytes"))
    own = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = join_salted(records.where("refers_to_id is not null").drop("payload_bytes"), firsts, "refers_to_id", "left", "page_id").withColumnRenamed("_bytes", "payload_bytes")
    return records.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long")).select(own).unionByName(again.select(own))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return join_revisits(materialize(read_archives(spark, path), "records"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS n, sha256(body) AS d FROM p),
     m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS o FROM h)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> o THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> o THEN o END AS refers_to
FROM m
"""
