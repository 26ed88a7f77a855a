import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from inkspan.operators import matching as mt
from inkspan.operators import redact


def naive(text, values):
    """Places of the values, each tried at each position; of one folded form the first value."""
    first = {}
    for v, p in values:
        if v:
            first.setdefault(mt.fold(v), (v, p))
    low = mt.fold(text or "")
    return sorted(((i, i + len(f), v, p) for f, (v, p) in first.items() for i in range(len(low)) if low.startswith(f, i)), key=lambda h: h[:2])


def replaced(text, hits, label):
    """A character at a time: which merged range it is in."""
    out, at = "", 0
    runs = []
    for s, e, _, p in hits:
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
            runs[-1][2].append(p)
        else:
            runs.append([s, e, [p]])
    for s, e, wants in runs:
        what = wants[0]
        for w in wants[1:]:
            if what is not None and not w:
                what = w
        out += text[at:s] + (label if what is None else what)
        at = e
    return out + text[at:]


words = st.text("aAbBİßé ", max_size=4)


@given(st.text("aAbBİßé ", max_size=40), st.lists(st.tuples(words, st.sampled_from([None, "", "X", "Y"])), max_size=6))
def test_automaton_equals_naive_search(text, values):
    found = mt.Matcher(values).find(text)
    assert found == naive(text, values)
    cuts = mt.merged(found)
    assert all(a[1] < b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    for v in {h[2] for h in found}:
        own = [h for h in mt.apart(found) if h[2] == v]
        low, at = [], 0
        while (at := mt.fold(text).find(mt.fold(v), at)) >= 0:
            low.append((at, at + len(v)))
            at += len(v)
        assert [h[:2] for h in own] == low


@pytest.mark.parametrize("texts", [mt.TEXTS, 7])
def test_places_and_sweep_by_document(spark, monkeypatch, texts):
    monkeypatch.setattr(mt, "TEXTS", texts)  # few: documents are dealt to parts
    rng = random.Random(2)
    docs = {d: [("".join(rng.choices("aAbBc é", k=rng.randrange(30))) if k else None) for k in range(rng.randrange(1, 40))] for d in [1, 2, 3, None]}
    values = {d: [("".join(rng.choices("aAbc", k=rng.randrange(4))), rng.choice([None, "", "X_1", "Y_2"])) for _ in range(8)] for d in [1, 2, None, 9]}
    frame = spark.createDataFrame([(d, i, t, "own") for d, own in docs.items() for i, t in enumerate(own)], "doc_id long, page int, text string, value string")
    given_ = spark.createDataFrame([(d, v, p, i) for d, own in values.items() for i, (v, p) in enumerate(own)], "doc_id long, value string, replacement string, seq int")
    got = mt.value_places(frame.drop("value"), given_, payload=mt.F.col("replacement"))
    want = [(d, i, v, s, e, p) for d, own in docs.items() for i, t in enumerate(own) for s, e, v, p in naive(t, values.get(d, []))]
    assert sorted(map(tuple, got.select("doc_id", "page", "value", "start", "end", "payload").collect()), key=repr) == sorted(want, key=repr) and want
    swept = mt.sweep(frame, given_, label="[X]")
    assert swept.columns == ["doc_id", "page", "text", "value", "swept"]
    want = [(d, i, t, "own", None if t is None else replaced(t, naive(t, values.get(d, [])), "[X]")) for d, own in docs.items() for i, t in enumerate(own)]
    assert sorted(map(tuple, swept.collect()), key=repr) == sorted(want, key=repr)


def test_first_value_of_a_folded_form_and_touching_places():
    m = mt.Matcher([("Bob", "P_1"), ("BOB", "P_2"), ("ob smith", None), ("@", "")])
    assert m.find("bob Smith") == [(0, 3, "Bob", "P_1"), (1, 9, "ob smith", None)]
    assert mt.merged(m.find("bob Smith")) == [(0, 9, None)] and mt.merged(m.find("BOB@x")) == [(0, 4, "")]
    assert [h[2] for h in mt.Matcher([("Bob", None), ("BOB", None)], every=True).find("bob")] == ["Bob", "BOB"]


def test_no_text_is_copied_for_a_value(spark):
    texts = spark.createDataFrame([(i % 3, i, f"value number {i} of many") for i in range(300)], "doc_id long, page int, text string")
    values = spark.range(3).selectExpr("id as doc_id", "explode(transform(sequence(0, 299), i -> concat('number ', i))) as value")
    plan = mt._together(texts, values, "text", None)
    assert plan.count() == 300 + 900
    leaks = redact.verify(texts, values)
    own = {(d, f"number {j}") for i in range(300) for d in [i % 3] for j in range(300) if str(i).startswith(str(j))}
    assert {tuple(r) for r in leaks.collect()} == own
    assert redact.verify(texts, values.where("value = 'number 7'"), values.select("doc_id", mt.F.col("value").alias("surrogate"))).count() == 0
