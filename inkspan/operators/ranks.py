"""Values at exact ranks and samples of exact size, without sorting a key's rows in one task.

A key with many rows is narrowed by histograms: the rows between two bounds are counted in buckets of equal width, combined
in each task first, and the bucket that holds the rank gives the next bounds. A round shrinks the range at least to one
bucket of ``BUCKETS``, until few distinct values are left, which are counted by value. Keys with few rows are gathered at
once. Nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspan.tables import kept

from .scoring import stratified_quota

#: Rows of a key that are gathered at once, buckets of a histogram, and keys whose bounds are broadcast.
FEW, BUCKETS, BROADCAST_KEYS = 100_000, 4096, 100_000


def _joined(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows joined to a table of one or few rows a key, nulls equal to nulls."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    keyed = keyed.withColumnsRenamed(names)
    small = F.broadcast(keyed) if keyed.count() <= BROADCAST_KEYS else keyed
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.join(small, on or F.lit(True), how).drop(*names.values())


def at_ranks(rows: DataFrame, keys: Sequence[str], value: str, targets: DataFrame, few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """targets' columns (keys, rank from 0, any others) with value: the value of that rank among the key's rows in ascending
    order. Nulls have no rank; a rank past the end has no row. Values are numbers."""
    k = list(keys)
    own = rows.select(*k, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    sizes = own.groupBy(*k).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    others = [c for c in targets.columns if c not in k]
    state = _joined(targets, kept(sizes, "sizes"), k).where((F.col("rank") >= 0) & (F.col("rank") < F.col("_n"))).select(*k, *others, "_n", "_lo", "_hi", F.col("rank").cast("long").alias("_left"))
    state = kept(state.withColumn("_t", F.monotonically_increasing_id()), "ranks")
    done = None
    while True:
        ready = (F.col("_n") <= few) | (F.col("_lo") == F.col("_hi")) | (F.col("_lo").cast("double") == F.col("_hi").cast("double"))
        now = _gathered(own, state.where(ready), k)
        done = now if done is None else done.unionByName(now)
        state = kept(state.where(~ready), "ranks")
        if state.isEmpty():
            break
        state = kept(_narrowed(own, state, k, buckets), "ranks")
    return done.select(*k, *others, "value")


def _within(own: DataFrame, state: DataFrame, k: list[str]) -> DataFrame:
    bounds = state.select(*k, "_t", "_lo", "_hi")
    return _joined(own, bounds, k).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _narrowed(own: DataFrame, state: DataFrame, k: list[str], buckets: int) -> DataFrame:
    low, high, v = (F.col(c).cast("double") for c in ("_lo", "_hi", "_v"))
    # halves keep the width finite where the bounds are far apart
    place = F.least(F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * buckets), F.lit(buckets - 1))
    counts = _within(own, state, k).groupBy("_t", place.alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w = Window.partitionBy("_t").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # rows are buckets
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    found = state.drop("_n", "_lo", "_hi").join(counts, "_t").where((F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_n")))
    return found.withColumn("_left", F.col("_left") - F.col("_before")).select(*state.columns)


def _gathered(own: DataFrame, state: DataFrame, k: list[str]) -> DataFrame:
    counts = _within(own, state, k).groupBy("_t", "_v").agg(F.count("*").alias("_c"))
    lists = counts.groupBy("_t").agg(F.sort_array(F.collect_list(F.struct("_v", "_c"))).alias("_all"))
    rows = state.join(lists, "_t")
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(own.schema["_v"].dataType).alias("v"))
    step = lambda s, x: F.struct((s["seen"] + x["_c"]).alias("seen"), F.when(s["v"].isNull() & (s["seen"] + x["_c"] > F.col("_left")), x["_v"]).otherwise(s["v"]).alias("v"))
    return rows.withColumn("value", F.aggregate("_all", start, step, lambda s: s["v"])).drop("_all")


def share_ranks(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """keys, share, rank: nearest ranks without interpolation, floor(share * n) from 0, at most the last; nulls do not count."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    each = n.select(*keys, "_n", F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share"))
    return each.select(*keys, "share", F.least(F.floor(F.col("_n") * F.col("share")), F.col("_n") - 1).alias("rank"))


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], few: int = FEW) -> DataFrame:
    """keys and a column for each share (p95 and so on): exact nearest ranks."""
    found = at_ranks(rows, keys, value, kept(share_ranks(rows, keys, value, shares), "shares"), few)
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("share") == float(s), F.col("value"))).alias(f"p{round(s * 100)}") for s in shares))


def seeded_hash(ident: Column, seed: int) -> Column:
    """60 bits of the MD5 of ``seed:ident``: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string"))), 1, 15), 16, 10).cast("long")


def stratified_sample(rows: DataFrame, stratum: str, ident: str, size: int, seed: int = 1, few: int = FEW) -> DataFrame:
    """``size`` rows (or all), from each stratum its quota by largest remainder: those of the least hashes, equal hashes by
    id. The same at any partitioning; a larger quota keeps what a smaller one had. Rows without an id are not drawn."""
    named = rows.where(F.col(ident).isNotNull()).withColumn("_h", seeded_hash(F.col(ident), seed))
    total = named.count()
    if size >= total:
        return named.drop("_h")
    quota = kept(stratified_quota(named, stratum, size).where("quota > 0"), "quota")
    targets = quota.select(stratum, (F.col("quota") - 1).alias("rank"), "quota")
    edge = kept(at_ranks(named, [stratum], "_h", targets, few).select(stratum, "quota", F.col("value").alias("_edge")), "edges")
    held = _joined(named, edge, [stratum]).where(F.col("_h") <= F.col("_edge"))
    under = held.groupBy(stratum).agg(F.count_if(F.col("_h") < F.col("_edge")).alias("_under"))
    tied = _joined(held.where("_h = _edge"), kept(under, "under"), [stratum])
    w = Window.partitionBy(stratum).orderBy(ident)  # rows of one hash
    tied = tied.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= F.col("quota") - F.col("_under"))
    return held.where("_h < _edge").select(*rows.columns).unionByName(tied.select(*rows.columns))
