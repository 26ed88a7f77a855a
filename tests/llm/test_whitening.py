import math

import numpy as np

from inkspan.llm import whitening as wh


def brute(rows, components=32):
    """Plain loops and numpy's eigh over the integer covariance: n, {row: deviation}, values, vectors, centred rows."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    off = n * x - sums
    centred = off.astype(float) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    return n, [(off[i] ** 2).sum() for i in range(n)], values[order], vectors[:, order], centred, sum((off**2).sum(axis=0)) / n**3


def test_matches_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, dev, values, vectors, centred, trace = brute(rows)
    got = wh.op13_whitening(spark, sf).toPandas()
    assert len(got) == 32 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == {v: d for (v, _), d in zip(rows, dev, strict=True)}
    by = got.pivot(index="vec_id", columns="component", values="whitened").loc[[v for v, _ in rows]].to_numpy()
    want = centred @ vectors[:, :32] / np.sqrt(values[:32])
    sign = np.sign((by * want).sum(axis=0))
    assert np.abs(by - want * sign).max() < 1e-6
    share = got.groupby("component").explained.first().to_numpy()
    assert np.abs(share / (values[:32] / trace) - 1).max() < 1e-9 and (np.diff(share) <= 0).all()
    assert np.abs(by.T @ by / n - np.eye(32)).max() < 1e-9


def test_defined_cases(spark):
    kind = "vec_id long, embedding array<float>, deviation string, x int, label int"
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, "a", 1, 1), (2, [1.0, None, 2.0], "a", 1, 1), (3, [nan, 1.0, 2.0], None, 1, 1), (4, [inf, 1.0, 2.0], "a", 1, 1), (5, [-inf, 0.0, 0.0], "a", 1, 1), (6, [], "", 0, 0), (7, [1.0, 2.0], "two", 0, 0), (8, [2.0**31, 0.0, 0.0], "", 0, 0)]
    assert wh.whiten(spark.createDataFrame(bad, kind)).count() == 0  # one row of the usual length is left: nothing varies
    assert wh.whiten(spark.createDataFrame([], kind)).collect() == []
    assert wh.whiten(spark.createDataFrame([(i, [1.5, -2.0], "", 0, 0) for i in range(9)], kind)).count() == 0
    fine = [(None, [0.5, 1.0, -1.0]), (10, [0.25, 2.0, 1.0]), (10, [0.25, 2.0, 1.0]), (11, [-3.0, 0.125, 1.0]), (12, [0.1, 0.2, 0.3]), (13, [-0.0, 5.0, 1.0])]
    got = wh.whiten(spark.createDataFrame(bad + [(i, v, "", 0, 0) for i, v in fine], kind)).toPandas()
    n, dev, values, vectors, centred, trace = brute(fine)
    assert len(got) == 18 and set(got.n) == {6} and sorted(got.deviation) == sorted(dev * 3)
    assert set(zip(got.component, got.explained.round(12), strict=True)) == {(k + 1, round(values[k] / trace, 12)) for k in range(3)}


def test_fewer_rows_than_dimensions(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, rng.normal(size=12).tolist()) for i in range(5)]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert set(got.component) == {1, 2, 3, 4} and got.identity_error[0] < 1e-4


def test_deviations_past_64_bits():
    off = np.array([[2**40, 1], [3, 4], [2**31, 2**31]])
    assert wh._deviations(off) == [None, 25, None]
    assert wh._deviations(np.array([[2**31, 5]])) == [2**62 + 25]
