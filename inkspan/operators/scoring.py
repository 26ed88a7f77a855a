"""Quality of detections against labelled spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import fixed
from inkspan.functions.text import normalize_value

from .spans import cover, covered_labels, fold_contained, touching, with_blanks

CUTOFFS = fixed.CUTOFFS


def score_documents(pages: DataFrame, gold: DataFrame, detections: DataFrame, cutoff: float | None = None, negatives: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels with overlap, covered, exact, strict; folded detections with value, correct, strict, negative) for pages
    (doc_id, text), gold (doc_id, start, end, category), detections (doc_id, start, end, category, confidence), negatives
    (doc_id, start, end: what only looks sensitive).

    A label is covered if detections hide all but white space of it, strict if those of its own category do, exact if one
    has its bounds. A detection is correct if it touches a label, strict if it touches one of its category, negative if it
    touches a negative and no label. Detections without a category are not scored. With a cutoff only detections of that
    confidence or more exist at all; ``by_cutoff`` folds first."""
    detections = detections.where("category is not null")
    if cutoff is not None:
        detections = detections.where(F.coalesce("confidence", F.lit(0.0)) >= cutoff)
    kept = _fold(detections)
    labels = cover(with_blanks(gold, pages, ["doc_id"]), kept, ["doc_id"])
    labels = labels.select(*gold.columns, "_blank", "_known", F.col("overlap").alias("_overlap"), F.col("strict").alias("exact"), F.col("covered").alias("_covered"))
    labels = cover(labels, detections, ["doc_id", "category"])
    labels = labels.select(*gold.columns, F.col("_overlap").alias("overlap"), "exact", F.col("_covered").alias("covered"), F.col("covered").alias("strict"))
    return labels, _found(pages, gold, kept, negatives)


def _fold(detections: DataFrame) -> DataFrame:
    return fold_contained(detections, ["doc_id"], [F.col("confidence").desc_nulls_last(), F.col("category")])


def _found(pages: DataFrame, gold: DataFrame, kept: DataFrame, negatives: DataFrame | None) -> DataFrame:
    def touched(spans: DataFrame, others: DataFrame, name: str, *same: str) -> DataFrame:
        out = touching(spans, others, ["doc_id", *same])
        return out.select(*spans.columns, (F.col("touched") & F.col("doc_id").isNotNull()).alias(name))

    found = touched(touched(kept, gold, "strict", "category"), gold, "correct")
    if negatives is None:
        found = found.withColumn("negative", F.lit(False))
    else:
        found = touched(found, negatives, "_lure").withColumn("negative", ~F.col("correct") & F.col("_lure")).drop("_lure")
    value = normalize_value(F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start")))
    return found.join(pages.select("doc_id", F.col("text").alias("_text")), "doc_id", "left").withColumn("value", value).drop("_text")


def tallies(pages: DataFrame, gold: DataFrame, detections: DataFrame, known: Sequence[str] = tuple(fixed.CATEGORIES)) -> tuple[DataFrame, DataFrame]:
    """((doc_id, detections, merged, false_positives), (category, unscored)): how many detections of known categories stand
    after folding, how many were folded into one around them, how many of those that stand touch no label; and how many
    there are of each category that is not known, which are in no other figure. Documents without detections have zeros."""
    scored = detections.where(F.col("category").isin(*known))
    kept = _fold(scored)
    found = _found(pages, gold, kept, None)
    n = scored.groupBy("doc_id").agg(F.count("*").alias("_all"))
    stand = found.groupBy("doc_id").agg(F.count("*").alias("detections"), F.count_if(~F.col("correct")).alias("false_positives"))
    out = pages.select("doc_id").distinct().join(n, "doc_id", "left").join(stand, "doc_id", "left").fillna(0, ["_all", "detections", "false_positives"])
    others = detections.where(~F.coalesce(F.col("category").isin(*known), F.lit(False))).groupBy("category").agg(F.count("*").alias("unscored"))
    return out.select("doc_id", "detections", (F.col("_all") - F.col("detections")).alias("merged"), "false_positives"), others


def by_cutoff(pages: DataFrame, gold: DataFrame, detections: DataFrame, cutoffs: Sequence[float] = CUTOFFS) -> DataFrame:
    """cutoff, detections, precision, recall: detections are folded first, then those of a confidence count; a label is
    covered by all of that confidence, folded or not. No rows if a confidence is missing."""
    detections = detections.where("category is not null")
    at = F.explode(F.array(*(F.lit(float(x)) for x in cutoffs))).alias("cutoff")
    above = detections.select("*", at).where("confidence >= cutoff")
    labels = covered_labels(gold.select("doc_id", "start", "end", at), above, pages, ["doc_id"], ["cutoff"])
    found = _found(pages, gold, _fold(detections), None).select("correct", "confidence", at).where("confidence >= cutoff")
    a = labels.groupBy("cutoff").agg(F.count("*").alias("labels"), F.count_if("covered").alias("covered"))
    b = found.groupBy("cutoff").agg(F.count("*").alias("detections"), F.count_if("correct").alias("correct"))
    sure = detections.agg((F.count_if(F.col("confidence").isNull()) == 0).alias("sure"))  # one row
    every = detections.sparkSession.range(1).select(at)
    out = every.join(a, "cutoff", "left").join(b, "cutoff", "left").join(F.broadcast(sure)).where("sure").fillna(0, ["labels", "covered", "detections", "correct"])
    return out.select("cutoff", "detections", _share(F.col("correct"), F.col("detections")).alias("precision"), _share(F.col("covered"), F.col("labels")).alias("recall"))


def _share(part: Column, whole: Column) -> Column:
    """Four decimals; null where there is nothing to share."""
    return F.when(whole > 0, F.round(part / whole, 4))


def aggregate(labels: DataFrame, found: DataFrame) -> DataFrame:
    """category (null: all), labels, covered, overlap, exact, strict, detections, correct, strict_correct, negative_hits,
    distinct, distinct_correct (by document, category and value), and precision, strict_precision, distinct_precision,
    recall, overlap_recall, strict_recall and f1 of them; shares are null where nothing is counted, and empty tables give no rows."""
    values = found.groupBy("doc_id", "category", "value").agg(F.bool_or("correct").alias("correct"))
    sides = [
        ("labels", labels, {"covered": "covered", "overlap": "overlap", "exact": "exact", "strict": "strict"}),
        ("detections", found, {"correct": "correct", "strict_correct": "strict", "negative_hits": "negative"}),
        ("distinct", values, {"distinct_correct": "correct"}),
    ]
    out, counts = None, []
    for name, df, flags in sides:
        df = df.groupingSets([("category",), ()], "category").agg(F.count("*").alias(name), *(F.count_if(F.col(c)).alias(k) for k, c in flags.items()), F.grouping("category").alias("_all"))
        counts += [name, *flags]
        out = df if out is None else out.join(df, (out["category"].eqNullSafe(df["category"])) & (out["_all"] == df["_all"]), "full").select(F.coalesce(out["category"], df["category"]).alias("category"), F.coalesce(out["_all"], df["_all"]).alias("_all"), *(c for c in counts))
    out = out.fillna(0, counts)
    shares = {"precision": ("correct", "detections"), "strict_precision": ("strict_correct", "detections"), "distinct_precision": ("distinct_correct", "distinct"), "recall": ("covered", "labels"), "overlap_recall": ("overlap", "labels"), "strict_recall": ("strict", "labels")}
    out = out.withColumns({k: _share(F.col(a), F.col(b)) for k, (a, b) in shares.items()})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 4))).drop("_all")


def weighted_cost(labels: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, cost: what missed labels and false positives weigh."""
    weights = F.create_map(*(F.lit(x) for kv in fixed.MISS_COSTS.items() for x in kv))
    missed = labels.where(~F.col("covered")).select("doc_id", F.coalesce(weights[F.col("category")], F.lit(2)).alias("c"))
    wrong = found.where(~F.col("correct")).select("doc_id", F.lit(fixed.FALSE_POSITIVE_COST).alias("c"))
    return missed.unionByName(wrong).groupBy("doc_id").agg(F.sum("c").alias("cost"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed and Cohen's kappa of two label columns, by counts of label pairs; kappa is null where chance is 1."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).count()
    total = cells.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("count")).otherwise(0)).alias("same"))
    ra, rb = cells.groupBy("a").agg(F.sum("count").alias("x")), cells.groupBy("b").agg(F.sum("count").alias("y"))
    chance = ra.join(rb, ra["a"] == rb["b"]).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    both = total.join(F.broadcast(chance))  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return both.select("n", F.round(po, 4).alias("observed"), F.round(F.when(pe != 1, (po - pe) / (1 - pe)), 4).alias("kappa"))


def attribute(labels: DataFrame, detections: DataFrame, pages: DataFrame, sources: Sequence[str] = ("patterns", "model", "expansion")) -> DataFrame:
    """labels with credit: the first source that covers a label alone, else ``together`` if all do, else null."""
    keys = labels.columns
    out = labels
    for s in (*sources, None):
        own = detections if s is None else detections.where(F.col("source") == s)
        got = covered_labels(labels, own.select("doc_id", "start", "end"), pages, ["doc_id"]).where("covered and overlap").select(*keys).distinct().withColumn(f"_{s}", F.lit(True))
        out = out.join(got, keys, "left")
    credit = F.coalesce(*(F.when(F.col(f"_{s}"), s) for s in sources), F.when(F.col("_None"), "together"))
    return out.withColumn("credit", credit).select(*keys, "credit")


def bootstrap(per_document: DataFrame, hit: str, total: str, rounds: int = 2000, seed: int = 1) -> DataFrame:
    """low, high: the 2.5 and 97.5 percentiles of sum(hit) / sum(total) over resamples of the documents. Each document
    draws its count of a round from Poisson(1) by a seeded hash, so rounds need no shuffle of documents."""
    import math

    cumulative, p = [], 0.0
    for k in range(8):
        p += math.exp(-1) / math.factorial(k)
        cumulative.append(p)
    u = F.pmod(F.xxhash64("doc_id", "round", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = sum(F.when(u >= c, 1).otherwise(0) for c in cumulative)
    drawn = per_document.select("doc_id", hit, total, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("_t", times)
    shares = drawn.groupBy("round").agg((F.sum(F.col(hit) * F.col("_t")) / F.sum(F.col(total) * F.col("_t"))).alias("s"))
    ordered = shares.agg(F.sort_array(F.collect_list("s")).alias("v"))  # one number a round
    return ordered.select(F.expr(f"v[{int(rounds * 0.025)}]").alias("low"), F.expr(f"v[{min(rounds - 1, int(rounds * 0.975))}]").alias("high"))


def stratified_quota(rows: DataFrame, stratum: str, size: int) -> DataFrame:
    """stratum, quota: shares of a sample by largest remainder, ties by name."""
    n = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    q = n.join(F.broadcast(total)).withColumn("_e", F.col("n") * size / F.col("t")).withColumn("_f", F.floor("_e"))
    from pyspark.sql.window import Window

    order = F.row_number().over(Window.orderBy((F.col("_e") - F.col("_f")).desc(), stratum))  # one row a stratum
    left = F.lit(size) - F.sum("_f").over(Window.partitionBy())
    return q.select(stratum, (F.col("_f") + F.when(order <= left, 1).otherwise(0)).cast("long").alias("quota"))
