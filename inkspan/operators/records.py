"""Redactions as records: their kind, their stored form, review by groups of values, and changes to a table in bulk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import fixed
from inkspan.functions.text import normalize_value

# Kinds of documents that are exported as pictures, whose ciphers have names too.
RASTER = ["pdf", "image"]
STATUSES = ["suggested", "accepted", "rejected"]
BOX = "struct<x:double,y:double,width:double,height:double>"
STORED = "id string, doc_id long, source string, type string, category string, confidence double, status string, method string, page int, text string, start int, end int, worksheet string, row int, col int, reason string, rule_id string, metadata string"
_PLAIN = [f.split()[0] for f in STORED.split(", ")[:-1]]


def short_surrogate(kind: Column) -> Column:
    return F.coalesce(kind.isin(*RASTER), F.lit(False))


def detection_type(category: Column, box: Column, worksheet: Column, row: Column, col: Column) -> Column:
    """face or region where there is a box, cell where there is a whole address (no row or column is 0), else text."""
    cell = (F.coalesce(worksheet, F.lit("")) != "") & (F.coalesce(row, F.lit(0)) != 0) & (F.coalesce(col, F.lit(0)) != 0)
    return F.when(box.isNotNull(), F.when(F.coalesce(category == "face", F.lit(False)), "face").otherwise("region")).when(cell, "cell").otherwise("text")


def to_stored(redactions: DataFrame) -> DataFrame:
    """Redactions (fields of ``STORED`` but metadata, with box and notes: a map) as they are stored: the box and the notes
    are one JSON object."""
    notes = F.coalesce(F.to_json("notes"), F.lit("{}"))
    box = F.to_json("box")
    joined = F.when(F.col("box").isNull(), notes).when(notes == "{}", F.concat(F.lit('{"box":'), box, F.lit("}"))).otherwise(F.concat(F.substring(notes, F.lit(1), F.length(notes) - 1), F.lit(',"box":'), box, F.lit("}")))
    return redactions.select(*_PLAIN, joined.alias("metadata"))


def from_stored(rows: DataFrame) -> DataFrame:
    """The redactions again. A method that is not known is none at all, which masks; metadata that is no object is empty."""
    box = F.from_json(F.get_json_object("metadata", "$.box"), BOX)
    notes = F.map_filter(F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: k != "box")
    return rows.select(*(F.when(F.col(c).isin(*fixed.STRENGTH), F.col(c)).alias(c) if c == "method" else c for c in _PLAIN), box.alias("box"), notes.alias("notes"))


def group_key(category: Column, text: Column) -> Column:
    return F.concat(category, F.lit("|"), normalize_value(F.coalesce(text, category)))


def suggestions(redactions: DataFrame, status: str | None = "suggested", category: str | None = None, source: str | None = None, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row for each value and category of a document: key, text, source, confidence and reason as first found (by seq),
    count, counts by status, pages in order. status: None for all."""
    rows = redactions
    for c, v in (("status", status), ("category", category), ("source", source)):
        rows = rows if v is None else rows.where(F.col(c) == v)
    first = lambda c, to: F.min_by(c, "seq").alias(to)
    shown = F.coalesce("text", "category")
    rows = rows.withColumn("key", group_key(F.col("category"), F.col("text"))).withColumn("_shown", shown)
    return rows.groupBy(*keys, "key").agg(
        first("_shown", "text"), first("category", "category"), first("source", "source"), first("confidence", "confidence"), first("reason", "reason"),
        F.count("*").alias("count"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.sort_array(F.collect_set("page")).alias("pages"),
    )


def decide(redactions: DataFrame, groups: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """(redactions with the pending ones of the groups (doc_id, key) decided; doc_id, updated, already_decided). What a
    person, a rule or an earlier decision has settled stays as it is. Groups that a document has not are not there."""
    if status not in STATUSES[1:]:
        raise ValueError("accept or reject")
    wanted = groups.select("doc_id", F.col("key").alias("_key")).distinct().withColumn("_asked", F.lit(True))
    key = group_key(F.col("category"), F.col("text"))
    rows = redactions.withColumn("_key", key).join(wanted, ["doc_id", "_key"], "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    pending = F.col("_asked") & (F.col("status") == "suggested")
    counts = rows.where("_asked").groupBy("doc_id").agg(F.count_if(F.col("status") == "suggested").alias("updated"), F.count_if(F.col("status") != "suggested").alias("already_decided"))
    return rows.withColumn("status", F.when(pending, status).otherwise(F.col("status"))).select(*redactions.columns), counts


def batch_overview(rules: DataFrame, copies: DataFrame, redactions: DataFrame) -> DataFrame:
    """rules (rule_id, ...) with documents and redactions: of copies of a rule in documents (copy_id, rule_id) and what the
    copies wrote (copy_id); rules without any have zeros. Redactions are counted by copy before they meet the rules."""
    wrote = redactions.groupBy("copy_id").agg(F.count("*").alias("_n"))
    own = copies.select("copy_id", "rule_id").join(wrote, "copy_id", "left").groupBy("rule_id").agg(F.count("*").alias("documents"), F.coalesce(F.sum("_n"), F.lit(0)).alias("redactions"))
    return rules.join(own, "rule_id", "left").fillna(0, ["documents", "redactions"])


def changed(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table after bulk changes (its columns, op: upsert or delete, seq): of a key the last change counts. Rows that are
    not named are carried over as they are; null fields of an upsert are null."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("op", *table.columns), "seq").alias("_c"))
    kept = table.join(last.select(key), key, "left_anti").select(*table.columns)
    return kept.unionByName(last.where("_c.op = 'upsert'").select(*(F.col(f"_c.{c}").alias(c) for c in table.columns)))
