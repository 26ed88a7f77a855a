import hashlib
import math

import duckdb
import numpy as np

from inkspan.llm import hamerly as hm


def brute(rows, k, rounds, size):
    """Plain integer k-means: {(row number): (vec_id, cluster, distance, cluster inertia, inertia, sha)}."""
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [r[1] for r in start[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for r in range(rounds + 1):
        own = [min((far(x, c), j) for j, c in enumerate(centers)) for _, x in rows]
        if r < rounds:
            for j in range(len(centers)):
                if held := [x for (_, x), (_, a) in zip(rows, own, strict=True) if a == j]:
                    centers[j] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    of = {j: sum(d for d, a in own if a == j) for _, j in own}
    return sorted(((i, a, d, of[a], sum(of.values()), sha[a]) for (i, _), (d, a) in zip(rows, own, strict=True)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.sql(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({hm.OP11_SQL})").fetchall()
    assert got(hm.op11_hamerly(spark, sf)) == sorted(want, key=str) and len(want) == 500


def test_bounds_spare_scans_and_hold(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    middles = rng.normal(size=(8, 4)) * 10
    rows = [(i, (middles[i % 8] + rng.normal(size=4)).tolist()) for i in range(600)]
    state, centers = hm.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 8, 6, 4)
    own = state.collect()
    assert 0 < sum(not r.scanned for r in own) and sum(r.scanned for r in own) < 300
    for r in own:
        d = sorted(math.sqrt(sum((a - b) ** 2 for a, b in zip(r.x, c, strict=True))) for c in centers.tolist())
        mine = math.sqrt(sum((a - b) ** 2 for a, b in zip(r.x, centers[r.cluster].tolist(), strict=True)))
        assert mine <= r.upper and mine == d[0] and (r.lower <= d[1] or r.upper < hm.spacing(centers)[r.cluster])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(hm.cluster_report(frame, 8, 6, 4)) == brute(rows, 8, 6, 4)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(60)] + [(100 + i, [0.5, 0.0]) for i in range(40)] + [(7, [1.0, 0.0])] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (1, 2, 7, 40):
        assert got(hm.cluster_report(frame, k, 4, 2)) == brute(rows, k, 4, 2)


def test_defined_cases(spark):
    kind = "vec_id long, embedding array<float>, cluster string, was int, label int"
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [-inf, 1.0]), (7, [])]
    fine = [(8, [0.001, -0.001]), (None, [0.5, -3.0]), (None, [9.0, 9.0]), (9, [-7.25, 1e-9]), (9, [-7.25, 2.0])]
    of = lambda rows: spark.createDataFrame([(i, v, "a", None, 1) for i, v in rows], kind)
    assert got(hm.cluster_report(of(bad + fine), 2, 3, 2)) == brute(bad + fine, 2, 3, 2)
    assert got(hm.cluster_report(of(fine), 40, 3, 2)) == brute(fine, 40, 3, 2)
    assert got(hm.cluster_report(of(bad), 3, 2, 2)) == [] and got(hm.cluster_report(of([]), 3, 2, 2)) == []
    assert got(hm.cluster_report(of([*fine, (10, [2.0**20, 0.0])]), 2, 3, 2)) == brute(fine, 2, 3, 2)
