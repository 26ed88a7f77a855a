"""Reports, usage, listings and the relational shapes behind them, over tables of any name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import percentiles

#: Redactions and documents that a task counts, about: it holds up to seven counts for each.
COUNTED = 200_000


def export_report(redactions: DataFrame) -> DataFrame:
    """doc_id, category, n, methods and sources of accepted redactions, the most frequent category first (rank)."""
    own = redactions.where("status = 'accepted'").groupBy("doc_id", "category").agg(
        F.count("*").alias("n"), F.count_if(F.col("source") == "rule").alias("by_rule"), F.count_if(F.col("source") == "ai").alias("by_detector"), F.count_if(F.col("source") == "user").alias("by_user")
    )
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "category")))


def export_counts(redactions: DataFrame, documents: DataFrame, method: Column, region_style: Column | None = None) -> DataFrame:
    """doc_id, section, key, count: what an export's report counts, never a value.

    redactions (doc_id, status, category, source, boxed), documents (doc_id, kind, narrowed: whether only a preset's
    categories were looked for). Sections: removed (by category; unknown ones are other), style (removed; in pictures solid,
    or ``region_style`` where there is a box), method and source of accepted ones; rejected and undecided by category, which are
    still in the export; note: weaker-style (blur or pixelate), narrowed, still-present, reversible, with their counts.
    Rows are dealt to as many tasks as there are times ``COUNTED`` of them, whatever the session's partitions."""
    from inkspan.functions.text import known_category

    parts = 1 + (redactions.count() + documents.count()) // COUNTED
    rows = redactions.repartition(parts, "doc_id").join(documents.select("doc_id", "kind").repartition(parts, "doc_id"), "doc_id")
    style = F.when(F.col("kind") != "image", "removed").when(F.col("boxed"), F.lit("solid") if region_style is None else region_style).otherwise("solid")
    rows = rows.select("doc_id", "status", "source", known_category(F.col("category")).alias("category"), style.alias("style"), method.alias("method"))
    accepted = F.col("status") == "accepted"
    left = F.when(F.col("status") == "rejected", "rejected").when(F.col("status") == "suggested", "undecided")
    facts = F.array(
        F.struct(F.when(accepted, F.lit("removed")).otherwise(left).alias("section"), F.col("category").alias("key")),
        *(F.struct(F.when(accepted, n).alias("section"), F.col(n).alias("key")) for n in ("style", "method", "source")),
        F.struct(F.when(accepted & F.col("style").isin("blur", "pixelate"), "note").alias("section"), F.lit("weaker-style").alias("key")),
        F.struct(F.when(accepted & F.col("method").isin("tokenize", "encrypt"), "note").alias("section"), F.lit("reversible").alias("key")),
        F.struct(F.when(left.isNotNull(), "note").alias("section"), F.lit("still-present").alias("key")),
    )
    counts = rows.select("doc_id", F.explode(facts).alias("f")).where("f.section is not null").groupBy("doc_id", F.col("f.section").alias("section"), F.col("f.key").alias("key")).agg(F.count("*").alias("count"))
    return counts.unionByName(documents.where("narrowed").select("doc_id", F.lit("note").alias("section"), F.lit("narrowed").alias("key"), F.lit(1).cast("long").alias("count")))


def leaking_reports(reports: DataFrame, values: DataFrame, least: int = 4) -> DataFrame:
    """doc_id, value of accepted values that a report (doc_id, report) repeats."""
    v = values.where(F.length("value") >= least)
    return reports.join(v, "doc_id").where(F.contains(F.lower("report"), F.lower("value"))).select("doc_id", "value").distinct()


def status_pivot(rows: DataFrame, key: str, status: str, names: Sequence[str]) -> DataFrame:
    """key, total and a count for each named status."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == n).alias(f"n_{n}") for n in names))


def rollup(rows: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Subtotals by prefixes of the keys; level is how many keys a row has."""
    return rows.rollup(*keys).agg(*aggregates, (F.lit(len(keys)) - sum(F.grouping(k) for k in keys)).cast("int").alias("level"))


def usage_cost(usage: DataFrame, prices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, calls, tokens, usd (null if any model's price is missing)."""
    rows = usage.join(prices, "model", "left").withColumn("_usd", F.col("tokens") * F.col("usd_per_million") / 1e6)
    return rows.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.when(F.count_if(F.col("_usd").isNull()) == 0, F.sum("_usd")).alias("usd"))


def spend_status(spent: Column, limit: Column) -> Column:
    return F.when(limit.isNull(), "none").when(spent >= limit, "reached").when(spent >= limit * 0.8, "near").otherwise("ok")


def newest_run(events: DataFrame, key: str, ts: str, kind: str, starts: str) -> DataFrame:
    """The events of each key since its last event of the kind that starts a run."""
    last = events.where(F.col(kind) == starts).groupBy(key).agg(F.max(ts).alias("_from"))
    return events.join(last, key).where(F.col(ts) >= F.col("_from")).drop("_from")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(o).desc() for o in order)))).where("_n = 1").drop("_n")


def fair_rotation(waiting: DataFrame, owner: str, *order: str, room: int) -> DataFrame:
    """At most ``room`` rows of each owner, in rounds: everyone's first, then everyone's second; turn says which."""
    w = Window.partitionBy(owner).orderBy(*order)
    return waiting.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= room)


def neighbours(rows: DataFrame, group: str, ident: str, *order: str) -> DataFrame:
    """Each row's position in its group, with the ids before and after."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.select("*", F.row_number().over(w).alias("position"), F.lag(ident).over(w).alias("previous_id"), F.lead(ident).over(w).alias("next_id"))


def nearest_rank(rows: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """The value of rank floor(share * n), from 0, without interpolation; nulls have no rank."""
    return percentiles(rows, keys, value, [share])


# Why a document is not in a batch's export.
SKIP_REASONS = ["not-ready", "cancelled", "verification-failed", "rate-limited", "archive-full", "export-failed", "container", "failed", "empty-container"]


def batch_outcomes(documents: DataFrame, removed: DataFrame, left: DataFrame, by: str = "batch_id") -> DataFrame:
    """by, section, key, documents, values: the report of an export for each batch, counts only.

    documents (batch, doc_id, reason: null if included, else one of ``SKIP_REASONS``: others end the job); removed (doc_id,
    category, style, method, count) and left (doc_id, count: rejected or undecided) of included documents; what is said of
    skipped ones does not count. Sections: included, skipped (by reason), category, style, not-removed, reversible (documents
    with tokenised or encrypted values) and pseudonymised."""
    known = F.when(F.col("reason").isNull() | F.col("reason").isin(*SKIP_REASONS), F.col("reason")).otherwise(F.raise_error(F.concat(F.lit("no reason to skip: "), "reason")))
    docs = documents.select(by, "doc_id", known.alias("reason"))
    inside = docs.where("reason is null").select(by, "doc_id")
    own = inside.join(removed, "doc_id")
    totals = own.groupBy(by, "doc_id").agg(F.sum("count").alias("n"))

    def section(df: DataFrame, name: str, key, values) -> DataFrame:
        keys = [by] if key is None else [by, F.col(key).alias("key")]
        out = df.groupBy(*keys).agg(F.count_distinct("doc_id").alias("documents"), values.cast("long").alias("values"))
        out = out.withColumn("key", F.lit(None).cast("string")) if key is None else out
        return out.select(by, F.lit(name).alias("section"), F.col("key").cast("string"), "documents", "values")

    total, none = F.coalesce(F.sum("count"), F.lit(0)), F.lit(0)
    parts = [
        section(inside.join(totals.select("doc_id", "n"), "doc_id", "left"), "included", None, F.coalesce(F.sum("n"), F.lit(0))),
        section(docs.where("reason is not null"), "skipped", "reason", F.max(none)),
        section(own, "category", "category", total), section(own, "style", "style", total),
        section(inside.join(left, "doc_id"), "not-removed", None, total),
        section(own.where("method in ('tokenize', 'encrypt') and count > 0"), "reversible", None, total),
        section(own.where("method = 'pseudonymize' and count > 0"), "pseudonymised", None, total),
    ]
    return reduce(DataFrame.unionByName, parts)


def free_slots(leases: DataFrame, slots: int, now: Column) -> DataFrame:
    """Slots from 1 to ``slots`` that no live lease (slot, expires) holds."""
    every = leases.sparkSession.range(1, slots + 1).select(F.col("id").cast("int").alias("slot"))
    return every.join(leases.where(F.col("expires") > now).select("slot"), "slot", "left_anti")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """id, path, level of a forest (id, parent, name), level by level until one is empty; siblings are named as they are."""
    level = nodes.where("parent is null").select("id", F.col("name").alias("path"), F.lit(0).alias("level"))
    out, i = level, 0
    while not level.isEmpty():
        i += 1
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("_p"))
        level = nodes.join(up, "parent").select("id", F.concat("_p", F.lit("/"), "name").alias("path"), F.lit(i).alias("level"))
        out = out.unionByName(level)
    return out


def column_samples(cells: DataFrame, most: int = 5) -> DataFrame:
    """Per sheet column: header, filled cells below it and the first of their values."""
    own = cells.where(F.length("value") > 0)
    head = own.where("row = 1").select("doc_id", "col", F.col("value").alias("header"))
    body = own.where("row > 1").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "col").orderBy("row")))
    stats = body.groupBy("doc_id", "col").agg(F.count("*").alias("filled"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "value")))), lambda s: s["value"]), "|").alias("samples"))
    return head.join(stats, ["doc_id", "col"], "full")
