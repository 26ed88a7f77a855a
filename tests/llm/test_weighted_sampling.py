import hashlib
import random
from collections import Counter

from inkspan.llm import weighted_sampling as ws


def jaccard(a, b):
    x, y = (dict(zip(*(v.tolist() for v in t))) for t in (a, b))
    keys = set(x) | set(y)
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


def test_collision_rate_is_generalised_jaccard():
    rng, s = random.Random(1), ws.Sampler(samples=2048, words=1)
    for n in (5, 40, 400, 6000):
        words = [f"w{i}" for i in range(n)]
        for share in (0.2, 0.5, 0.9):
            a = rng.choices(words, k=n)
            b = [w if rng.random() < share else rng.choice(words) for w in a] + rng.choices(words[:3], k=n // 3)
            ta, tb = s.terms(" ".join(a)), s.terms(" ".join(b))
            assert max(Counter(a).values()) > 1 or n == 5
            assert abs(ws.likeness(s.sample(*ta), s.sample(*tb)) - jaccard(ta, tb)) < 0.05


def test_collision_rate_with_more_terms_than_draws():
    """Past the pool's 65,536 rows, with counts above 1, against all terms."""
    rng, s = random.Random(2), ws.Sampler(samples=1024, words=1)
    words = [f"w{i}" for i in range(150_000)]
    for share in (0.3, 0.8):
        b = [w if rng.random() < share else w + "x" for w in words]
        ta, tb = s.terms(" ".join(words + words[:20_000])), s.terms(" ".join(b + b[:30_000]))
        assert len(ta[0]) > 2 * ws.POOL
        assert abs(ws.likeness(s.sample(*ta), s.sample(*tb)) - jaccard(ta, tb)) < 0.06


def test_ranges_are_partitions_of_their_own(spark):
    docs = spark.createDataFrame([(i % 97, "x" * (i % 50)) for i in range(400)], "doc_id long, text string")
    parts = ws.in_order(docs, part_bytes=300).select(ws.F.spark_partition_id().alias("p"), "_part", "copy", "doc_id").collect()
    of = {}
    for r in parts:
        of.setdefault(r.p, set()).add(r._part)
    assert all(len(x) == 1 for x in of.values()) and len(of) > 20
    assert sum(1 for r in parts if not r.copy) == 400
    low = {r._part: min(x.doc_id for x in parts if x._part == r._part and not x.copy) for r in parts}
    for p, n in low.items():
        after = [low[q] for q in sorted(low) if low[q] > n] or [min(low.values())]
        assert {r.doc_id for r in parts if r._part == p and r.copy} == {after[0]}


def test_terms_are_five_word_shingles():
    s = ws.Sampler()
    assert len(s.terms("a b c")[0]) == 1 and len(s.terms("a b c d e f")[0]) == 2
    assert s.terms("A b  c\td e A b c d e")[1].tolist().count(2) == 1
    assert not s(" \n").any()
    assert (s("x y z " * 5000) == s("x y z " * 5000)).all()


def test_query_against_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in ws.op4_weighted_sampling(spark, sf).collect()}
    assert len(got) == len(docs)
    s = ws.Sampler()
    for i, (doc, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (ws.to_hex(s(text)), ws.to_hex(s(edited)))
        assert (r.near_edited, r.near_next) == (ws.likeness(s(text), s(edited)), ws.likeness(s(text), s(after)))


def test_defined_cases(spark, tmp_path):
    spark.createDataFrame([(None, "n"), (5, None), (5, "a"), (9, ""), (9, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.n_chars, r.near_next) for r in ws.op4_weighted_sampling(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, 0.0), (5, 0, 0.0), (5, 1, 0.0), (9, 0, 1.0), (9, 0, 0.0)], key=str)
    spark.createDataFrame([(1, "solo x", 3)], "doc_id long, text string, copy int").write.parquet(f"{tmp_path}/one/documents.parquet")
    assert [(r.doc_id, r.near_next) for r in ws.op4_weighted_sampling(spark, f"{tmp_path}/one").collect()] == [(1, 1.0)]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert ws.op4_weighted_sampling(spark, f"{tmp_path}/none").count() == 0
    assert ws.fingerprint_documents(spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")).select("fingerprint").distinct().count() == 1
