r"""Dropping lines that many documents share; DataFrame functions only.

Lines are exploded with their positions, normalised and hashed once, into a narrow table without text. Distinct documents
are counted for each hash (pairs of hash and document are made distinct first, so a line that a third of all documents
holds is spread over tasks and its counts are combined before they meet). Hashes found in many documents give the
positions that a document loses, and the lines that stay are put together again by position. A line's key is told by
128 bits of hash: two XXH64 with different seeds.

Defined cases: a null or empty text is one empty line; a document is known by its id, so rows that share an id count as one
document and none of them loses a line that this id is the largest to hold; null ids count as one document, which is
never the largest; rows of one id with different texts keep their own lines; all columns pass ``drop_lines``, and extra
columns with any name do not matter to ``line_dedup``; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALT, materialize, table, whole_text

#: Code points that a key has at least, and documents that hold it at least, for its lines to go.
KEY_CHARS, DOCUMENTS = 40, 5
#: Hashes of frequent lines that are broadcast at most (24 bytes each); more are joined by a salted shuffle.
BROADCAST_KEYS = 500_000
SPACE = " \t\n\x0b\f\r"


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def lowered(line: Column) -> Column:
    """A-Z in lower case and nothing else; where all is ASCII, ``lower`` does the same at once."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, string.ascii_uppercase, string.ascii_lowercase))


def _row() -> list[Column]:
    """128 bits that name a row by id and text."""
    own = [F.col("doc_id").isNull(), F.col("doc_id"), whole_text()]
    return [F.xxhash64(*own).alias("_r1"), F.xxhash64(F.lit(7), *own).alias("_r2")]


def hashed_lines(docs: DataFrame, key_chars: int = KEY_CHARS) -> DataFrame:
    """_r1, _r2, doc_id, pos, _h1, _h2 for each line whose key is long enough."""
    lines = docs.select(*_row(), "doc_id", F.posexplode(F.split(whole_text(), "\n")).alias("pos", "line"))
    lines = lines.where(F.octet_length("line") >= key_chars).withColumn("line", bare(F.col("line"))).where(F.length("line") >= key_chars)
    key = lowered(F.col("line"))
    return lines.select("_r1", "_r2", "doc_id", "pos", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(7), key).alias("_h2"))


def frequent(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """_h1, _h2, owner: hashes that enough documents hold, with the largest id of these."""
    held = lines.select("_h1", "_h2", "doc_id").distinct().groupBy("_h1", "_h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("owner"))
    return held.where(F.col("n") >= documents).drop("n")


def lost(lines: DataFrame, often: DataFrame) -> DataFrame:
    """_r1, _r2, _drops: the positions that a row loses."""
    if often.count() <= BROADCAST_KEYS:
        met = lines.join(F.broadcast(often), ["_h1", "_h2"])
    else:
        copied = often.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = lines.withColumn("_salt", F.coalesce(F.pmod("_r1", F.lit(SALT)).cast("int"), F.lit(0))).join(copied, ["_h1", "_h2", "_salt"])
    return met.where(~F.col("doc_id").eqNullSafe(F.col("owner"))).groupBy("_r1", "_r2").agg(F.collect_set("pos").alias("_drops"))


def drop_lines(docs: DataFrame, key_chars: int = KEY_CHARS, documents: int = DOCUMENTS) -> DataFrame:
    """The documents, all columns, with the text that is left, and n_lines (before dropping) and n_dropped."""
    found = materialize(hashed_lines(docs, key_chars), "lines")
    often = materialize(frequent(found, documents), "frequent")
    # lines are split below the join, so that the walk over positions does not split the text again for each
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(*_row(), F.struct(*rest).alias("_rest"), F.split(whole_text(), "\n").alias("_lines"))  # no name clashes
    rows = rows.join(lost(found, often), ["_r1", "_r2"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_drops", F.array().cast("array<int>")))
    text = F.concat_ws("\n", F.transform(stay, lambda i: F.get("_lines", i)))
    text = F.when(F.col("_drops").isNull(), F.array_join("_lines", "\n")).otherwise(text).alias("text")
    n_dropped = F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped")
    return rows.select("_rest.*", text, F.size("_lines").cast("long").alias("n_lines"), n_dropped)


def line_dedup(docs: DataFrame, key_chars: int = KEY_CHARS, documents: int = DOCUMENTS) -> DataFrame:
    """One row per document: doc_id, text (what is left), n_lines, n_dropped."""
    return drop_lines(docs.select("doc_id", "text"), key_chars, documents)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM t),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
     often AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     m AS (SELECT k.doc_id, line, pos, coalesce(owner <> doc_id, false) AS gone FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
