"""Algebra of spans: merging, folding, joining by overlap, entities, and all occurrences of values."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspan.functions.text import normalize_value, stands_alone

from .matching import value_places

#: Values that an automaton, which every task holds, may have; more are joined by their documents.
BROADCAST_VALUES = 100_000


def merged_runs(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The spans that are not empty with _run: spans of the same keys that overlap or touch share it."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where("end > start").withColumn("_new", F.when(before >= F.col("start"), 0).otherwise(1))
    return marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_ranges(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal ranges; touching ones merge, empty ones go. Columns: keys, start, end."""
    return merged_runs(spans, keys).groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def fold_contained(spans: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Drop spans that end within what an earlier, or longer equal-start, span of the same keys reaches."""
    w = Window.partitionBy(*keys).orderBy(F.col("start"), F.col("end").desc(), *order).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("end").over(w)).where("_reach is null or end > _reach").drop("_reach")


def collapse_duplicates(detections: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """One row for each place and value: the most confident, the first on ties."""
    w = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), F.col(seq))
    return detections.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedupe(detections: DataFrame) -> DataFrame:
    """Collapse duplicates by place and folded text, then fold what is contained, by document, page and category."""
    rows = detections.withColumn("_norm", normalize_value(F.col("text")))
    rows = collapse_duplicates(rows, ["doc_id", "page", "start", "end", "_norm"]).drop("_norm")
    return fold_contained(rows, ["doc_id", "page", "category"], [F.col("seq")])


def build_entities(detections: DataFrame, keys: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """A row for each folded value: first text, count, the most confident row's category, whether any is everywhere."""
    rows = detections.withColumn("normalized", normalize_value(F.col("text"))).where("normalized != ''")
    best = F.struct(F.col("confidence"), (-F.col(seq)).alias("o"))
    return rows.groupBy(*keys, "normalized").agg(
        F.min_by("text", seq).alias("value"), F.count("*").alias("occurrences"), F.max("confidence").alias("confidence"),
        F.max_by("category", best).alias("category"), F.coalesce(F.bool_or("everywhere"), F.lit(False)).alias("everywhere"),
    )


def overlap(a_start, a_end, b_start, b_end) -> Column:
    return (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", width: int = 512) -> DataFrame:
    """left and right spans of the same keys that share a character, right's columns prefixed ``r_``; once a pair.

    Spans are dealt to bins of ``width`` characters, so that a page with many spans does not compare all pairs; a pair
    counts in the bin where the later of the two starts. ``how``: inner, left_semi or left_anti."""
    k = list(keys)
    r = right.select(*k, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in k))
    lb = left.withColumn("_bin", F.explode(F.expr(f"sequence(start div {width}, greatest(end - 1, start) div {width})")))
    rb = r.withColumn("_bin", F.explode(F.expr(f"sequence(r_start div {width}, greatest(r_end - 1, r_start) div {width})")))
    on = [lb[c].eqNullSafe(rb[c]) for c in k] + [lb["_bin"] == rb["_bin"], overlap("start", "end", "r_start", "r_end")]
    if how == "inner":
        both = lb.join(rb, [*on, lb["_bin"] == F.expr(f"greatest(start, r_start) div {width}")])
        return both.select(*(lb[c] for c in left.columns), *(rb[c] for c in r.columns if c not in k))
    hit = lb.join(rb, on, "left_semi").select(*left.columns).distinct()
    return hit if how == "left_semi" else left.join(hit, [left[c].eqNullSafe(hit[c]) for c in left.columns], "left_anti")


def touching(spans: DataFrame, others: DataFrame, keys: Sequence[str], blank: str | None = None) -> DataFrame:
    """spans with touched, equal and hidden: whether others of the same keys (null with null) share a character with each, one
    that is not empty has its bounds, and they hide it whole, together with the ranges of ``blank``, a column of arrays of
    (start, end) that the spans of the same keys have.

    No pairs: starts and ends of a group are passed once in order, with how many are open. A span is told at its end by the
    last place before it that is bare, or covered. An empty span touches what it lies strictly within, as in ``overlap``."""
    k, end, probe, start, point, blank_end, blank_start = list(keys), 0, 1, 2, 3, 4, 5
    event = lambda at, since, kind: F.struct(at.cast("long").alias("_at"), since.cast("long").alias("_from"), F.lit(kind).alias("_kind"))
    s, e = F.col("start"), F.col("end")
    own = event(e, s, probe)
    if blank:
        ranges = F.transform(blank, lambda r: F.array(event(r["end"], r["start"], blank_end), event(r["start"], r["start"], blank_start)))
        own = F.explode(F.concat(F.array(own), F.coalesce(F.flatten(ranges), F.array().cast("array<struct<_at:bigint,_from:bigint,_kind:int>>"))))
    rows = spans.select("*", own.alias("_e")).select(*spans.columns, "_e.*", F.lit(True).alias("_own"))
    ends = F.when(e > s, F.array(event(e, s, end), event(s, s, start))).when(e == s, F.array(event(e, s, point)))
    rows = rows.unionByName(others.select(*k, F.explode(ends).alias("_e")).select(*k, "_e.*", F.lit(False).alias("_own")), allowMissingColumns=True)
    w = Window.partitionBy(*k).orderBy("_at", "_from", "_kind")
    before, kind = w.rowsBetween(Window.unboundedPreceding, -1), F.col("_kind")
    step = F.when(kind == start, 1).when(kind == end, -1).otherwise(0)
    blank_step = F.when(kind == blank_start, 1).when(kind == blank_end, -1).otherwise(0)
    last = lambda c: F.last(F.when(kind == end, F.col(c)), True).over(before)
    rows = rows.withColumns({"_open": F.coalesce(F.sum(step).over(before), F.lit(0)), "_blanks": F.coalesce(F.sum(blank_step).over(before), F.lit(0)), "_last": F.max("_at").over(before), "_point": F.max(F.when(kind == point, F.col("_at"))).over(before), "_a": last("_at"), "_f": last("_from")})
    moved = F.col("_last").isNull() | (F.col("_at") > F.col("_last"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_until": F.max(F.when(moved & (F.col("_open") > 0), F.col("_at"))).over(upto), "_bare": F.max(F.when(moved & (F.col("_open") + F.col("_blanks") == 0), F.col("_at"))).over(upto)})
    no = F.lit(False)
    touched = F.when(e > s, F.coalesce(F.col("_until") > s, no) | F.coalesce(F.col("_point") > s, no)).when(e == s, F.col("_open") > 0).otherwise(False)
    equal = F.coalesce((F.col("_a") == e) & (F.col("_f") == s), no)
    hidden = F.coalesce((e <= s) | (F.col("_bare") <= s), F.lit(True))
    return rows.where(F.col("_own") & (kind == probe)).select(*spans.columns, touched.alias("touched"), equal.alias("equal"), hidden.alias("hidden"))


def with_blanks(labels: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """labels with _blank, the ranges of each that are white space or behind its page's end (null: none), and _known, whether
    there is a text."""
    body, size = F.col("_body"), F.col("end") - F.col("start")
    out = labels.join(pages.select(*keys, F.col("text").alias("_text")), list(keys), "left")
    out = out.select(*labels.columns, F.substring(F.col("_text"), F.col("start") + 1, size).alias("_body"))
    span = lambda a, b: F.struct((F.col("start") + a).alias("start"), (F.col("start") + b).alias("end"))
    white = F.filter(F.transform(F.split(body, ""), lambda x, i: F.when(x.rlike(r"\s"), span(i, i + 1))), lambda r: r.isNotNull())
    behind = F.array(span(F.length(body), size))
    blank = F.when(body.rlike(r"\s") & (F.length(body) < size), F.concat(white, behind)).when(body.rlike(r"\s"), white).when(F.length(body) < size, behind)
    return out.select(*labels.columns, blank.alias("_blank"), body.isNotNull().alias("_known"))


def cover(labels: DataFrame, detections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What ``covered_labels`` gives, for labels ``with_blanks`` and detections of the same keys; those two columns stay."""
    out = touching(labels, detections.select(*keys, "start", "end").where("end > start"), keys, "_blank")
    some = F.col("_known") & F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    return out.select(*labels.columns, (some & F.col("touched")).alias("overlap"), F.col("equal").alias("strict"), (~F.col("_known") | F.col("hidden")).alias("covered"))


def covered_labels(labels: DataFrame, detections: DataFrame, pages: DataFrame, keys: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """labels (keys, start, end) with overlap, strict and covered: whether detections touch, equal, or hide all but white
    space of each. Only detections that agree in the columns ``same`` (null with null) count; pages have the keys alone."""
    return cover(with_blanks(labels, pages, keys), detections, [*keys, *same]).drop("_blank", "_known")


def find_all(text: str, value: str) -> list[tuple[int, int]]:
    """Matches of a value that do not overlap, whatever the case; folded a character at a time, so offsets hold."""
    fold = lambda s: "".join(c if len(low := c.lower()) != 1 else low for c in s)
    hay, needle, out, at = fold(text), fold(value), [], 0
    while needle and (at := hay.find(needle, at)) >= 0:
        out.append((at, at + len(needle)))
        at += len(needle)
    return out


def automaton_hits(pages: DataFrame, values: DataFrame, most: int = BROADCAST_VALUES) -> DataFrame:
    """doc_id, page, value, start, end of every occurrence, overlapping ones too, of every value (column ``value``),
    whatever the case. The automaton is sent to all tasks: more than ``most`` distinct values are refused; join values
    to their own documents (``expand_occurrences``) instead."""
    import ahocorasick

    rows = values.select(F.col("value")).where("length(trim(value)) > 0").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} values: expand them by document")
    shared = pages.sparkSession.sparkContext.broadcast(sorted(r[0] for r in rows))
    kinds = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = lambda s: "".join(c if len(low := c.lower()) != 1 else low for c in s)
        machine, first = ahocorasick.Automaton(), {}
        for v in shared.value:
            first.setdefault(fold(v), v)  # one value for each folded form
        for folded, v in first.items():
            machine.add_word(folded, (len(folded), v))
        machine.make_automaton()
        for b in batches:
            out = []
            for doc, page, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if first:
                    out += [(doc, page, v, e + 1 - n, e + 1) for e, (n, v) in machine.iter(fold(text or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], schema=kinds)

    return pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text").mapInArrow(run, "doc_id long, page int, value string, start int, end int")


def expand_occurrences(detections: DataFrame, pages: DataFrame, confidence: float = 0.9, standalone: bool = True) -> DataFrame:
    """All places of each document's everywhere-values in all pages of the document; each page is passed over once."""
    values = detections.where("everywhere").withColumn("_norm", normalize_value(F.col("text"))).where("_norm != ''")
    values = values.groupBy("doc_id", "_norm").agg(F.min_by("text", "seq").alias("value"), F.min("seq").alias("seq"), F.min_by("category", "seq").alias("category"), F.min_by("reason", "seq").alias("reason"))
    about = F.to_json(F.struct("category", "reason"))
    rows = value_places(pages.select("doc_id", "page", F.col("text").alias("_text")), values, "_text", about, alone=True)
    if standalone:
        rows = rows.where(stands_alone(F.col("_text"), F.col("start"), F.col("end")))
    about = F.from_json("payload", "category string, reason string")
    return rows.select("doc_id", "page", about["category"].alias("category"), F.lit(confidence).alias("confidence"), "start", "end", F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), about["reason"].alias("reason"), F.lit(True).alias("everywhere"))


def expand_cells(detections: DataFrame, cells: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Cells (doc_id, row, col, value) that hold a document's everywhere-values, once for each value, as whole cells: doc_id,
    row, col, category, confidence, text (the value as it was first found), reason, everywhere."""
    values = detections.where("everywhere").withColumn("_norm", normalize_value(F.col("text"))).where("_norm != ''")
    values = values.groupBy("doc_id", "_norm").agg(F.min_by("text", "seq").alias("value"), F.min("seq").alias("seq"), F.min_by("category", "seq").alias("category"), F.min_by("reason", "seq").alias("reason"))
    about = F.to_json(F.struct("category", "reason", F.col("value").alias("text")))
    rows = value_places(cells.select("doc_id", "row", "col", F.col("value").alias("_text")), values, "_text", about).select("doc_id", "row", "col", "payload").distinct()
    a = F.from_json("payload", "category string, reason string, text string")
    return rows.select("doc_id", "row", "col", a["category"].alias("category"), F.lit(confidence).alias("confidence"), a["text"].alias("text"), a["reason"].alias("reason"), F.lit(True).alias("everywhere"))


_SEAM = re.compile(r"[ \t]*,?[ \t]*\n?[ \t]*\Z")


def join_adjacent(detections: DataFrame, pages: DataFrame) -> DataFrame:
    """Merge neighbours of one page and category of which one has source ``patterns`` and the other ``model`` (sources:
    an array column) and only a comma, spaces and one line break between; chains."""
    schema = "doc_id long, page int, category string, confidence double, start int, end int, text string, sources array<string>"

    def run(key, spans: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        text = page["text"].iloc[0] if len(page) else ""
        out: list[dict] = []
        for d in spans.sort_values(["start", "end"], kind="stable").to_dict("records"):
            d["sources"] = set(d["sources"])
            p = out[-1] if out else None
            if p and p["category"] == d["category"] and p["end"] <= d["start"] and _SEAM.match(text[p["end"] : d["start"]]) and (("patterns" in p["sources"] and "model" in d["sources"]) or ("model" in p["sources"] and "patterns" in d["sources"])):
                p |= {"end": d["end"], "text": text[p["start"] : d["end"]], "confidence": max(p["confidence"], d["confidence"]), "sources": p["sources"] | d["sources"]}
            else:
                out.append(d)
        return pd.DataFrame([{**d, "sources": sorted(d["sources"])} for d in out], columns=["doc_id", "page", "category", "confidence", "start", "end", "text", "sources"])

    own = detections.select("doc_id", "page", "category", "confidence", "start", "end", "text", "sources")
    return own.groupBy("doc_id", "page").cogroup(pages.select("doc_id", "page", "text").groupBy("doc_id", "page")).applyInPandas(run, schema)


def locate(text: Column, value: Column) -> Column:
    """The start of a value in a text: as it is, else whatever the case and white space; null if it is absent. Code points."""
    exact = F.position(value, text)
    loose = F.concat(F.lit("(?iu)"), F.regexp_replace(F.regexp_replace(normalize_value(value), r"([\\^$.|?*+()\[\]{}])", r"\\$1"), " ", r"\\s+"))
    hit = F.regexp_substr(text, loose)
    return F.when(exact > 0, exact - 1).when(hit.isNotNull() & (hit != ""), F.position(hit, text) - 1)
