from hypothesis import given, settings
from hypothesis import strategies as st

from inkspan.operators import compare

spans = st.lists(st.tuples(st.integers(-2, 22), st.integers(-2, 24)), max_size=5)


def hidden(text, ranges):
    return {i for s, e in ranges for i in range(max(0, s), min(len(text), e)) if ord(text[i]) not in compare.SPACES}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("ab \n é　", max_size=22), spans, spans, spans), min_size=1, max_size=6))
def test_equals_sets_of_characters(spark, docs):
    pages = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(docs)], "doc_id long, text string")
    frame = lambda k, extra="": spark.createDataFrame([(i, s, e, "person" if s % 2 else None) for i, d in enumerate(docs) for s, e in d[k]], "doc_id long, start int, end int, category string")
    every = pages.select("doc_id")
    pairs, characters = compare.compared(pages, frame(1), frame(2), frame(3), every)
    want, count = [], []
    for i, (t, gold, a, b) in enumerate(docs):
        a, b = hidden(t, a), hidden(t, b)
        want += [(i, "person" if s % 2 else None, hidden(t, [(s, e)]) <= a, hidden(t, [(s, e)]) <= b) for s, e in gold]
        count.append((i, len(a & b), len(a | b)))
    assert sorted(map(tuple, pairs.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, characters.collect())) == count


def test_summary(spark):
    pages = spark.createDataFrame([(1, "Ann lives here"), (2, "no one"), (3, None)], "doc_id long, text string")
    gold = spark.createDataFrame([(1, 0, 3, "person"), (1, 4, 9, "other"), (2, 0, 2, "person")], "doc_id long, start int, end int, category string")
    a = spark.createDataFrame([(1, 0, 3), (1, 4, 10), (3, 0, 4)], "doc_id long, start int, end int")
    b = spark.createDataFrame([(1, 0, 2), (1, 4, 9), (3, 0, 1)], "doc_id long, start int, end int")
    rows = {r.category: r for r in compare.run_agreement(pages, gold, a, b).collect()}
    assert set(rows) == {None, "person", "other"} and rows[None][1:6] == (2, 1, 1, 0, 0)  # document 2 was scored by neither
    assert rows[None].observed == 0.5 and rows[None].kappa == 0.0 and rows[None].redacted_jaccard == round(7 / 8, 4)
    assert rows["other"].kappa is None and rows["other"].observed == 1.0 and rows["person"].redacted_jaccard is None
    none = compare.run_agreement(pages, gold.limit(0), a.limit(0), b.limit(0)).collect()
    assert [(r.category, r.labels, r.observed, r.kappa, r.redacted_jaccard) for r in none] == [(None, 0, None, None, None)]


def test_hidden_labels_are_those_whose_common_parts_count_alike():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(0, 40))
        full = rng.random(n) < 0.7
        filled = np.r_[0, np.cumsum(full)]
        r = compare._clipped([{"start": s, "end": s + k} for s, k in zip(rng.integers(-3, 40, 5).tolist(), rng.integers(-1, 9, 5).tolist(), strict=True)], n)
        labels = np.array([(s, s + k) for s, k in zip(rng.integers(-5, 45, 6).tolist(), rng.integers(-2, 12, 6).tolist(), strict=True)])
        count = lambda x, filled=filled: int((filled[x[1]] - filled[x[0]]).sum())
        own = [compare._clipped([{"start": s, "end": e}], n) for s, e in labels.tolist()]
        assert compare.hides(labels, r, full).tolist() == [count(compare.overlaps(o, r)) == count(o) for o in own]
