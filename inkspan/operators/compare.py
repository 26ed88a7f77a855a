"""How far two runs over the same documents agree: by labelled value and by character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as white space.
SPACES = [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_FILLED = np.ones(0x110000, bool)
_FILLED[SPACES] = False


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges that hold the same characters, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.r_[True, starts[1:] > reach[:-1]]
    return starts[first], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(starts) - 1]]


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The common parts of two lists of disjoint ranges: a sweep over all their bounds."""
    bounds = np.unique(np.concatenate([*a, *b]))
    if len(bounds) < 2:
        return bounds[:0], bounds[:0]
    within = lambda r: np.searchsorted(r[0], bounds[:-1], "right") > np.searchsorted(r[1], bounds[:-1], "right")
    both = within(a) & within(b)
    return bounds[:-1][both], bounds[1:][both]


def _clipped(spans: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.clip(np.array([(s["start"], s["end"]) for s in spans], np.int64).reshape(-1, 2), 0, n)
    x = x[x[:, 1] > x[:, 0]]
    return runs(x[:, 0], x[:, 1])


def hides(labels: np.ndarray, r: tuple[np.ndarray, np.ndarray], full: np.ndarray) -> np.ndarray:
    """Whether disjoint ranges hold all characters that are not white space of each label (start, end): ``full`` says which
    characters those are."""
    n = len(full)
    edges = np.zeros(n + 1, np.int8)
    edges[r[0]] += 1
    edges[r[1]] -= 1
    bare = np.r_[0, np.cumsum(full & (np.cumsum(edges)[:n] == 0))]
    start, end = np.clip(labels, 0, n).T
    return bare[np.maximum(start, end)] == bare[start]


def compared(pages: DataFrame, gold: DataFrame, first: DataFrame, second: DataFrame, scored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, category, a, b): whether either run hides all but white space of each label; (doc_id, both, either): hidden
    characters without white space). Texts (doc_id, text); labels (doc_id, start, end, category); runs (doc_id, start, end).
    Documents that both runs scored (``scored``; else those where both have spans) are compared, each as one row: its spans
    are gathered, its text is passed over once, and counts come from prefix sums at the spans' bounds."""
    if scored is None:
        scored = first.select("doc_id").distinct().join(second.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = pages.select("doc_id", "text").join(scored.select("doc_id").distinct(), "doc_id", "left_semi")
    kinds = "array<struct<start:int,end:int,category:string>>"
    for name, df in (("g", gold), ("a", first), ("b", second)):
        category = F.col("category") if name == "g" else F.lit(None)
        one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), category.cast("string").alias("category"))
        rows = rows.join(df.groupBy("doc_id").agg(F.collect_list(one).alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("category", pa.string()), ("a", pa.bool_()), ("b", pa.bool_())])
        for batch in batches:
            pairs, both, either = [], [], []
            for i in range(batch.num_rows):
                text, g, a, b = (batch.column(c)[i].as_py() for c in range(1, 5))
                codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
                full = _FILLED[codes]
                filled = np.r_[0, np.cumsum(full)]
                a, b = (_clipped(x, len(codes)) for x in (a, b))
                count = lambda r, filled=filled: int((filled[r[1]] - filled[r[0]]).sum())
                at = np.array([(s["start"], s["end"]) for s in g], np.int64).reshape(-1, 2)
                pairs.append([{"category": s["category"], "a": x, "b": y} for s, x, y in zip(g, hides(at, a, full).tolist(), hides(at, b, full).tolist(), strict=True)])
                both.append(count(overlaps(a, b)))
                either.append(count(a) + count(b) - both[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pairs, pa.list_(pair)), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["doc_id", "pairs", "both", "either"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, pairs array<struct<category:string,a:boolean,b:boolean>>, both long, either long")
    return out.select("doc_id", F.explode("pairs").alias("p")).select("doc_id", "p.*"), out.select("doc_id", "both", "either")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4))


def run_agreement(pages: DataFrame, gold: DataFrame, first: DataFrame, second: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """category (null: all), labels, both_covered, only_first, only_second, neither, observed, kappa (null where chance is
    certain) and, for all, redacted_jaccard: of the characters that either run hides the share that both do."""
    pairs, characters = compared(pages, gold, first, second, scored)
    cells = pairs.groupBy("category").agg(*(F.count_if(F.expr(e)).alias(n) for n, e in (("both_covered", "a and b"), ("only_first", "a and not b"), ("only_second", "b and not a"), ("neither", "not a and not b"))))
    names = ["both_covered", "only_first", "only_second", "neither"]
    total = cells.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).withColumn("category", F.lit(None).cast("string")).withColumn("_all", F.lit(True))
    rows = cells.withColumn("_all", F.lit(False)).unionByName(total)
    n = sum((F.col(x) for x in names), F.lit(0))
    some = F.when(n > 0, n)
    same, pa_, pb = ((F.col("both_covered") + F.col(x)) / some for x in ("neither", "only_first", "only_second"))
    chance = pa_ * pb + (1 - pa_) * (1 - pb)
    hidden = characters.agg(_share(F.coalesce(F.sum("both"), F.lit(0)), F.coalesce(F.sum("either"), F.lit(0))).alias("_j"))
    rows = rows.join(F.broadcast(hidden))  # one row
    kappa = F.round((same - chance) / F.when(chance != 1, 1 - chance), 4)
    return rows.select("category", n.alias("labels"), *names, F.round(same, 4).alias("observed"), kappa.alias("kappa"), F.when(F.col("_all"), F.col("_j")).alias("redacted_jaccard"))
