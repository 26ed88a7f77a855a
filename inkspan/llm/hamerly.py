"""Clustering by centroids with Hamerly's bounds; all distances that decide are exact integers.

Every vector carries one upper bound of the distance to its own centroid and one lower bound of the distance to any other.
A round writes them with the vector as a Parquet table in the shared folder: the next round loosens them by how far the
centroids have moved, and a vector whose upper bound is below the lower one (or below half the distance from its centroid
to the nearest other) keeps its cluster without a distance. Else its own distance is computed; if that does not decide,
the vector is ambiguous and all centroids are scanned in exact integers, equal distances going to the smaller number. Bounds
are doubles rounded away from each other, so they never decide a tie.

Centroids are updated from the vectors that changed cluster only: their sums, added to the new cluster and taken from the
old one, are combined in each task and are k rows of d numbers on the driver, whatever the number of vectors.

Defined cases: rows whose vector is null, has not ``size`` components, or holds a null, a non-finite entry or one of
magnitude 2**19 or more (whose squares would leave 64 bits) are dropped. With fewer vectors than centroids there are as
many centroids as vectors. Repeated vec_ids are rows of their own; among equal hashes smaller vectors start first; null
ids start last. Equal centroids: the smaller number has all, the other stays empty where it is. Extra columns do not
pass. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lists, table, table_of

SIZE, CENTROIDS, ROUNDS, SCALE, LARGEST = 64, 40, 5, 256, 2.0**19
#: Bounds are widened by this share at every step; doubles are exact to 1e-16.
SLACK = 1e-12
STATE = "vec_id long, x array<int>, cluster int, was int, upper double, lower double, scanned boolean"
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _exact(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST)


def quantised(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id, x (array of ints) of the rows that can be used."""
    fine = (F.size("embedding") == size) & F.forall("embedding", _exact)
    x = F.transform("embedding", lambda c: F.when(_exact(c), F.floor(c.cast("double") * SCALE).cast("int")))  # Spark may evaluate it first
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", x.alias("x"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    name = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    got = rows.orderBy(name.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r.x for r in got], dtype=np.int64)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=1)


def scan(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, its squared distance, the second smallest squared distance) in integers."""
    best, first = np.zeros(len(x), np.int32), np.full(len(x), np.iinfo(np.int64).max)
    second = first.copy()
    for j, c in enumerate(centers):
        d = _squared(x, c)
        nearer = d < first
        second = np.where(nearer, first, np.minimum(second, d))
        best[nearer], first[nearer] = j, d[nearer]
    return best, first, second


def spacing(centers: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other."""
    half = np.full(len(centers), np.inf)
    for j, c in enumerate(centers):
        d = np.delete(_squared(centers, c), j)
        half[j] = np.sqrt(d.min()) / 2 * (1 - SLACK) if len(d) else np.inf
    return half


def assign(state: DataFrame, centers: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The state with clusters and bounds for the centroids, each of which has moved by ``drift`` since."""
    half, far = spacing(centers), drift * (1 + SLACK)
    # for a vector of cluster a: how far any other centroid has moved at most
    others = np.array([np.delete(far, a).max() if len(far) > 1 else 0.0 for a in range(len(far))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, was = _vectors(b.column(1)), b.column(2).to_numpy()
            upper, lower = b.column(3).to_numpy().copy(), b.column(4).to_numpy().copy()
            cluster, known = was.copy(), was >= 0
            upper[known] = (upper[known] + far[was[known]]) * (1 + SLACK)
            lower[known] -= others[was[known]] + np.abs(lower[known]) * SLACK
            open_ = np.flatnonzero(~known | (upper >= np.maximum(lower, np.where(known, half[was], 0))))
            own = open_[known[open_]]
            upper[own] = np.sqrt(_squared(x[own], centers[was[own]])) * (1 + SLACK)
            still = np.flatnonzero(~known)
            still = np.concatenate([still, own[upper[own] >= np.maximum(lower[own], half[was[own]])]])
            best, first, second = scan(x[still], centers)
            cluster[still], upper[still] = best, np.sqrt(first) * (1 + SLACK)
            lower[still] = np.sqrt(second) * (1 - SLACK)
            scanned = np.zeros(len(x), bool)
            scanned[still] = True
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (cluster, was, upper, lower, scanned))], names=["vec_id", "x", "cluster", "was", "upper", "lower", "scanned"])

    return state.select("vec_id", "x", "cluster", "upper", "lower").mapInArrow(run, STATE)


def moved_sums(state: DataFrame, k: int, size: int) -> list:
    """(cluster, pos, total) rows of what changing vectors add to the sums, at pos -1 to the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size + 1), np.int64)
        for b in batches:
            x = np.concatenate([np.ones((b.num_rows, 1), np.int64), _vectors(b.column(0))], axis=1) if b.num_rows else np.zeros((0, size + 1), np.int64)
            to, was = b.column(1).to_numpy(), b.column(2).to_numpy()
            np.add.at(sums, to, x)
            np.subtract.at(sums, was[was >= 0], x[was >= 0])
        cluster, pos = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(pos.astype(np.int32) - 1), pa.array(sums[cluster, pos])], names=["cluster", "pos", "part"])

    part = state.where("cluster != was").select("x", "cluster", "was").mapInArrow(run, "cluster int, pos int, part long")
    return part.groupBy("cluster", "pos").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """(the final state, the final centroids)."""
    spark, rows = vectors.sparkSession, quantised(vectors, size)
    centers = first_centroids(rows, k)
    k = len(centers)
    state = rows.select("vec_id", "x", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    if not k:
        return spark.createDataFrame([], STATE), centers
    held, path, drift = [[0] * (size + 1) for _ in range(k)], None, np.zeros(k)
    for r in range(rounds + 1):
        old = path
        state, path = table_of(assign(state, centers, drift), "clusters")
        if old:
            discard(spark, old)
        if r == rounds:
            break
        for row in moved_sums(state, k, size):
            held[row.cluster][row.pos + 1] += int(row.total)
        new = np.array([[s // own[0] for s in own[1:]] if own[0] else centers[j].tolist() for j, own in enumerate(held)], dtype=np.int64)
        drift, centers = np.sqrt(_squared(new, centers)), new
    return state, centers


def with_distance(state: DataFrame, centers: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance: exact and squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(_squared(_vectors(b.column(1)), centers[own]))], names=["vec_id", "cluster", "distance"])

    return state.select("vec_id", "x", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_report(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    state, centers = cluster(vectors, k, rounds, size)
    if not len(centers):
        return vectors.sparkSession.createDataFrame([], OUT)
    own = with_distance(state, centers)
    sums = {r.cluster: int(r.s) for r in own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = [(j, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centers[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    about = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return own.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


def sql(k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> str:
    """The same by plain scans: a pair of common table expressions for each round. Whole numbers in doubles are exact."""
    whole = "len(embedding) = {0} AND list_count(embedding) = {0} AND list_bool_and([isfinite(c) FOR c IN embedding])".format(size)
    near = """a{0} AS MATERIALIZED (SELECT i, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT), 'cluster': cluster}}) AS m
     FROM v CROSS JOIN c{0} GROUP BY i)"""
    mean = """s{1} AS (SELECT cluster, p, CAST(sum(e) AS HUGEINT) AS s, count(*) AS n FROM (SELECT m.cluster AS cluster, unnest(x) AS e, generate_subscripts(x, 1) AS p FROM a{0}) GROUP BY cluster, p),
     m{1} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY p) AS c FROM s{1} GROUP BY cluster),
     c{1} AS MATERIALIZED (SELECT c{0}.cluster, coalesce(m{1}.c, c{0}.c) AS c FROM c{0} LEFT JOIN m{1} ON c{0}.cluster = m{1}.cluster)"""
    steps = ", ".join(near.format(r) + ", " + mean.format(r, r + 1) for r in range(rounds)) + ", " + near.format(rounds)
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, [floor({SCALE} * CAST(c AS DOUBLE)) FOR c IN embedding] AS x FROM embeddings WHERE {whole}),
     c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, x AS c FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT {k})),
     {steps}
SELECT vec_id, m.cluster AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string([CAST(CAST(e AS BIGINT) AS VARCHAR) FOR e IN c], ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.m.cluster = c{rounds}.cluster
"""


OP11_SQL = sql()
