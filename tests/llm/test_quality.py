import zlib

import numpy as np

from inkspan.llm import quality as q


def test_held_out_accuracy_and_contract(spark):
    d = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = q.op9_quality(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    own = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert np.mean([a == b for a, b in own]) > 0.95
    assert np.mean([a == b for a, b in own if b == 0]) > 0.85


def test_prior_is_recovered():
    rng = np.random.Generator(np.random.PCG64(1))
    p = np.c_[rng.normal(1, 1, (3000, 1)), np.ones(3000)]
    for share in (0.3, 0.6, 0.9):
        n = int(6000 * share)
        u = np.c_[np.r_[rng.normal(1, 1, (n, 1)), rng.normal(-3, 1, (6000 - n, 1))], np.ones(6000)]
        assert abs(q.class_prior(p, u) - share) < 0.05


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1), (None, "a b c", 1), (5, "z " * 1_000_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1, None), (2, 1, None), (5, 0, 1), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = q.score(docs, q.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert q.score(docs.limit(0), q.train(docs, labels.limit(0))).count() == 0
    assert q.Model(np.zeros((0, 16)), np.zeros((0, 16))).score("x") == 1.0


def test_bins_and_prior_cover_all_rows_that_are_not_held_out(spark):
    """Against plain loops over every text; the samples for the weights are a small part of them."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    own = {r.doc_id: q.statistics(r.text or "") for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert len(own) > 700
    model = q.train(docs, labels, positives=60, unlabelled=100)
    want = [[sorted(int(v[k] * q.GRID // 1) for v in own.values())[int((len(own) - 1) * s)] / q.GRID for s in q.SHARES] for k in range(16)]
    assert model.edges.tolist() == want
    seen = {}

    def prior(p, u):
        w = q.separator(p, u)
        z = {d: int(q.steps_of(q.with_ones(v[None], model.edges) @ w)[0]) for d, v in own.items()}
        good = [s for d, s in z.items() if label.get(d) == 1]
        ratios = [(sum(s >= cut for s in z.values()) / len(z)) / (sum(s >= cut for s in good) / len(good)) for cut in set(z.values()) if sum(s >= cut for s in good) >= 0.2 * len(good)]
        seen["prior"] = min(max(min(ratios), 0.05), 0.95)
        seen["rows"] = len(p), len(u)
        return seen["prior"]

    def some(df, most, n, seed):
        F = q.F
        return df.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < min(1.0, most / n) * (1 << 20))

    good = labels.where("quality = 1").where(~q.held_out())
    known = labels.where("quality is not null").where(~q.held_out())
    p, u = (np.array(sorted(own[r.doc_id].tolist() for r in some(df, most, df.count(), seed).collect() if r.doc_id in own)) for df, most, seed in ((good, 60, 1), (known, 100, 2)))
    again = q.Model(p, u, model.edges, prior)
    assert model.prior == seen["prior"] and 20 < seen["rows"][0] < 120 and 50 < seen["rows"][1] < 180
    assert np.allclose(model.weights, again.weights)
