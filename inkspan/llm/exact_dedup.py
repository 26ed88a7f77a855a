"""Exact deduplication through an extendible-hash index on shared files; DataFrame functions only.

A text's key is its XXH64. The directory maps the leading bits of a key to a bucket: it starts as one bucket and doubles
while a bucket holds more than ``capacity`` entries, each overfull bucket splitting in two by its next bit, up to
``max_depth`` bits; what then still collides stays in its bucket. Chain entries (one for each distinct byte string under
a key) come out of an aggregation by key and bytes, so copies are combined before the shuffle and equality is decided
by comparing bytes. Owner tasks take ranges of (bucket, key), number the chains and write the buckets as files in the
shared folder; an entry of a chain of several holds its bytes.

A document probes by the directory cell of its key: the cell names the bucket, and bucket and key find the chain. A
chain of one entry is the document's own, as every probed text was indexed; a longer one is walked by comparing bytes.

Defined cases: a null text is the empty text; a null id is never the smallest unless all ids of a group are null;
rows repeated with the same id all carry that id's verdict; an empty table gives an empty result; extra columns do not
pass ``exact_dedup``, all columns pass ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table, whole_text

#: Entries that a bucket holds before it splits, and bits of the directory at most. What is broadcast of it are the cells
#: of its depth, twice as many as the buckets or so: entries / 10,000 rows, 1,048,576 at most.
CAPACITY, MAX_DEPTH = 20_000, 20
#: Colliding keys that are broadcast at most; more are joined by a shuffle. 64 bits collide once in 10**9 texts or so.
BROADCAST_KEYS = 1_000_000
#: Runs of white space that are not one plain space already: far fewer matches than all runs, the same result.
SPACES = "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def _keyed(docs: DataFrame, key_bits: int) -> DataFrame:
    norm = normalised(whole_text())
    key = F.xxhash64(norm)
    if key_bits < 64:  # fewer bits make collisions, for tests
        key = F.shiftleft(key, 64 - key_bits)
    return docs.select("doc_id", norm.alias("_norm"), key.alias("_key"))


def _cell(depth: int) -> Column:
    return F.shiftrightunsigned(F.shiftrightunsigned("_key", 63 - depth), 1)  # in two steps: 64 bits at once are none


def directory(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """((cell, depth, bucket) for the cells in use, the directory's depth): a cell is the first bits, as many as the
    directory is deep, of a key; a bucket is the cell where it starts, depth the bits that its keys share. It starts with
    one cell and doubles, a bit a round, until no bucket is overfull or ``max_depth`` is reached."""
    counts = entries.groupBy(_cell(max_depth).alias("prefix")).agg(F.count("*").alias("n"))
    now = materialize(counts.select("prefix", "n", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bucket")), "directory")
    deep = 0
    while deep < max_depth:
        held = now.where(F.col("depth") == deep).groupBy("bucket").agg(F.sum("n").alias("held"))
        over = held.where(F.col("held") > capacity).select("bucket", F.lit(True).alias("_over"))
        if over.isEmpty():
            break
        bit = 1 << (max_depth - deep - 1)
        split = now.join(F.broadcast(over), "bucket", "left")  # as many rows as there are buckets, at most
        upper = F.when(F.col("_over") & (F.col("prefix").bitwiseAND(F.lit(bit)) != 0), F.lit(bit)).otherwise(0)
        deep += 1
        now = materialize(split.select("prefix", "n", F.when(F.col("_over"), deep).otherwise(F.col("depth")).alias("depth"), (F.col("bucket") + upper).cast("long").alias("bucket")), "directory")
    rest = max_depth - deep
    return materialize(now.select(F.shiftright("prefix", rest).alias("cell"), "depth", F.shiftright("bucket", rest).alias("bucket")).distinct(), "cells"), deep


class Index:
    """A built index: ``cells`` (the directory, ``deep`` bits) and ``buckets`` (its files, read back: bucket, depth, _key, chain, length,
    body, text_sha256, keep_id, group_size; length is the number of entries of a chain, body null where that is one)."""

    def __init__(self, cells: DataFrame, buckets: DataFrame, collided: DataFrame, deep: int, key_bits: int):
        self.cells, self.buckets, self.collided, self.deep, self.key_bits = cells, buckets, collided, deep, key_bits

    def probe(self, docs: DataFrame) -> DataFrame:
        """Each of the indexed documents with the entry of its text."""
        rows = _keyed(docs, self.key_bits).join(self.collided, "_key", "left")
        body = F.when(F.col("_many"), F.col("_norm"))  # bytes travel only where there is something to compare
        rows = rows.select("doc_id", "_key", _cell(self.deep).alias("cell"), body.alias("_body"))
        rows = rows.join(F.broadcast(self.cells.select("cell", "bucket")), "cell").drop("cell")
        return rows.join(self.buckets, ["bucket", "_key"]).where(F.col("_body").eqNullSafe(F.col("body"))).drop("_body", "body")


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key_bits: int = 64) -> Index:
    entries = _keyed(docs, key_bits).groupBy("_key", "_norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = materialize(entries.select("_key", F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size"), "entries")
    collided = materialize(entries.groupBy("_key").agg(F.count("*").cast("int").alias("length")).where("length > 1").withColumn("_many", F.lit(True)), "collided")
    n = collided.count()
    known = F.broadcast(collided) if n <= BROADCAST_KEYS else collided
    cells, deep = directory(entries, capacity, max_depth)
    owned = entries.withColumn("cell", _cell(deep)).join(F.broadcast(cells), "cell").drop("cell")
    owned = owned.join(known.drop("_many"), "_key", "left").withColumn("length", F.coalesce("length", F.lit(1)))
    if n:  # the bytes of chains that have something to compare
        bodies = _keyed(docs, key_bits).join(known, "_key", "left_semi").select("_key", F.col("_norm").alias("body"), F.sha2("_norm", 256).alias("text_sha256")).distinct()
        owned = owned.join(bodies, ["_key", "text_sha256"], "left")
    else:
        owned = owned.withColumn("body", F.lit(None).cast("string"))
    chain = F.row_number().over(Window.partitionBy("bucket", "_key").orderBy("keep_id", "text_sha256")) - 1
    owned = owned.repartitionByRange("bucket", "_key").withColumn("chain", chain)
    buckets = materialize(owned.select("bucket", "depth", "_key", "chain", "length", "body", "text_sha256", "keep_id", "group_size"), "buckets")
    return Index(cells, buckets, known.select("_key", "_many"), deep, key_bits)


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    found = build_index(docs, capacity, max_depth, key_bits).probe(docs)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that stay by what their probes of the index find; a row repeated with id and text stays
    once. Probes carry ids and keys; texts meet what stays by id and digest, so a large group of copies does not meet in one
    task."""
    at = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = build_index(docs).probe(docs).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = found.select(at.alias("_at"), F.col("text_sha256").alias("_of")).distinct()
    rows = docs.withColumns({"_at": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_of": F.sha2(normalised(whole_text()), 256)})
    return rows.join(kept, ["_at", "_of"], "left_semi").dropDuplicates(["_at", "_of"]).drop("_at", "_of")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("bucket", "chain")


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
