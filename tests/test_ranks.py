import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspan.operators import ranks


def brute(values, share):
    own = sorted(v for v in values if v is not None)
    return own[min(math.floor(len(own) * share), len(own) - 1)] if own else None


@pytest.mark.parametrize("few", [3, 100_000])
def test_percentiles_are_exact(spark, few):
    rng = random.Random(few)
    groups = {"flat": [rng.random() for _ in range(4000)], "same": [7.0] * 500, "far": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(900)], "one": [3.0], None: [float(rng.randrange(5)) for _ in range(300)], "none": [None] * 5, "extreme": [1.7e308, -1.7e308, 0.0, 5e-324, -5e-324]}
    rows = spark.createDataFrame([(k, v) for k, own in groups.items() for v in own], "k string, v double").repartition(7)
    got = {r.k: (r.p0, r.p50, r.p95, r.p100) for r in ranks.percentiles(rows, ["k"], "v", [0.0, 0.5, 0.95, 1.0], few).collect()}
    assert got == {k: tuple(brute(own, s) for s in (0.0, 0.5, 0.95, 1.0)) for k, own in groups.items() if k != "none"}


def test_whole_numbers_past_double_precision(spark):
    rows = spark.createDataFrame([("a", (1 << 60) + i % 50) for i in range(400)], "k string, v long")
    targets = spark.createDataFrame([("a", r, f"t{r}") for r in (0, 8, 399, 400, -1)] + [("b", 0, "no")], "k string, rank long, name string")
    assert sorted((r.name, r.value) for r in ranks.at_ranks(rows, ["k"], "v", targets, few=2).collect()) == [("t0", 1 << 60), ("t399", (1 << 60) + 49), ("t8", (1 << 60) + 1)]
    assert ranks.percentiles(rows.limit(0), ["k"], "v", [0.5]).count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60), st.floats(0, 1))
def test_fuzz(spark, values, share):
    rows = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    assert ranks.percentiles(rows, ["k"], "v", [share], few=2).first()[1] == brute(values, share)


def test_samples(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 7 % 3], "x") for i in range(700)] + [(None, "a", "x")], "id long, kind string, _h string")
    names = lambda df: sorted(r.id for r in df.collect())
    one = names(ranks.stratified_sample(rows, "kind", "id", 101, 1, few=10))
    quota = {r.kind: r.quota for r in ranks.stratified_quota(rows.where("id is not null"), "kind", 101).collect()}
    own = {}
    for i in range(700):
        own.setdefault("abc"[i % 7 % 3], []).append(i)
    assert {k: sum(i in set(one) for i in v) for k, v in own.items()} == quota and len(one) == 101
    assert one == names(ranks.stratified_sample(rows.repartition(13), "kind", "id", 101, 1)) and one != names(ranks.stratified_sample(rows, "kind", "id", 101, 2))
    assert names(ranks.stratified_sample(rows, "kind", "id", 10_000)) == list(range(700))
    assert set(names(ranks.stratified_sample(rows.where("kind = 'a'"), "kind", "id", 20))) < set(names(ranks.stratified_sample(rows.where("kind = 'a'"), "kind", "id", 50)))
    tied = spark.createDataFrame([(1, "a", i) for i in range(9)] + [(2, "a", 0)], "id long, kind string, n int")
    assert ranks.stratified_sample(tied, "kind", "id", 4).count() == 4
