import random

import pytest

from inkspan.operators import paging, upkeep
from inkspan.operators.rules import PatternError

WORDS = ["ann", "bob", "x1", "y2", "zed"]


def change(seq, op, rule, **f):
    own = {k: f.get(k) for k in upkeep.FIELDS}
    return (seq, op, rule, f.get("batch_id"), *own.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_changes_equals_a_rebuild(spark, tmp_path, seed):
    rng = random.Random(seed)
    texts = [(d, 1, " ".join(rng.choices(WORDS, k=12))) for d in range(12)]
    docs = [(d, "ab"[d % 2]) for d in range(12)]
    state, said, known, seq = upkeep.BatchRules(spark, str(tmp_path)), [], 6, 0
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    for epoch in range(4):
        own = []
        for _ in range(5):
            seq += 1
            op, rule = rng.choice(["create", "create", "update", "update", "remove"]), rng.choice("rst")
            if op == "create":
                own.append(change(seq, op, rule, batch_id="ab"["rst".index(rule) % 2], pattern=rng.choice(WORDS), kind="literal", category=rng.choice(["person", "other"]), origin=rng.randrange(12)))
            else:
                own.append(change(seq, op, rule, **({rng.choice(["pattern", "category"]): rng.choice(WORDS)} if rng.random() < 0.6 else {"enabled": rng.random() < 0.5})))
        said += own
        grown = min(12, known + 2)
        now, pages = frame(docs[:grown], "doc_id long, batch_id string"), frame(texts[:grown], "doc_id long, page int, text string")
        for _ in range(2 if epoch == 1 else 1):  # a run that is repeated
            state.apply(epoch, frame(own, upkeep.CHANGES), now, pages, frame([(d,) for d in range(known, grown)], "doc_id long"))
        known = grown
        want = upkeep.rebuilt(frame(said, upkeep.CHANGES), now, pages)
        got = state.rows().drop("epoch")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert state.rows().count() and state.redactions().first().status == "accepted"
    with pytest.raises(ValueError):
        state.apply(0, frame([], upkeep.CHANGES), now, pages)


def test_only_what_changes_is_searched_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, batch_id string")
    pages = spark.createDataFrame([(1, 1, "ann bob"), (2, 1, "bob Ann"), (3, 1, "ann")], "doc_id long, page int, text string")
    state = upkeep.BatchRules(spark, str(tmp_path))
    make = lambda *rows: spark.createDataFrame(list(rows), upkeep.CHANGES)
    state.apply(1, make(change(1, "create", "r", batch_id="a", pattern="ann", origin=1), change(2, "create", "s", batch_id="a", pattern="bob", match_case=True)), docs, pages)
    assert sorted((r.rule_id, r.doc_id, r.from_origin) for r in state.rows().collect()) == [("r", 1, True), ("r", 2, False), ("s", 1, False), ("s", 2, False)]
    state.apply(2, make(change(3, "update", "r", enabled=False), change(4, "update", "s", pattern="bob"), change(5, "update", "nope", pattern="x")), docs, pages)
    assert sorted((r.rule_id, r.epoch) for r in state.rows().collect()) == [("s", 1), ("s", 1)]  # s says the same: its rows stay
    state.apply(3, make(change(6, "update", "r", enabled=True, category="person")), docs, pages)
    assert sorted((r.rule_id, r.doc_id, r.epoch, r.category) for r in state.rows().where("rule_id = 'r'").collect()) == [("r", 1, 3, "person"), ("r", 2, 3, "person")]
    with pytest.raises(PatternError):
        state.apply(4, make(change(7, "create", "t", batch_id="a", pattern=" ")), docs, pages)
    assert state.rows().count() == 4 and {r.rule_id for r in state.rules().collect()} == {"r", "s"}
    state.apply(4, make(change(7, "remove", "r"), change(8, "remove", "s")), docs, pages)
    assert state.rows().count() == 0 and state.rules().count() == 0


def test_pages_joined_are_the_whole(spark):
    rows = [(i, i // 7, i % 3) for i in random.Random(1).sample(range(300), 100)] + [(None, 1, 1), (999, None, 1)]
    df = spark.createDataFrame(rows, "id long, at int, kind int")
    got, cursor, pages = [], None, 0
    while True:
        page, cursor = paging.next_page(df, ["at", "id"], cursor, 13)
        if not page:
            break
        pages += 1
        got += [r.id for r in page]
        if pages == 2:  # put in ahead and behind
            df = df.unionByName(spark.createDataFrame([(5000, 40, 0), (-1, -1, 0)], df.schema))
    assert got == [r[0] for r in sorted([x for x in rows if None not in x] + [(5000, 40, 0)], key=lambda r: (r[1], r[0]))]
    plan = df.where(paging.after(["at", "id"], [3, 4]))._jdf.queryExecution().optimizedPlan().toString()
    assert "(at" in plan and ">= 3" in plan


def test_sweep_goes_on_after_a_restart(spark, tmp_path):
    left = {i: (i, i % 5, None if i % 4 else (i + 1 if i % 8 else None)) for i in range(40)}
    seen = []

    def documents():
        return spark.createDataFrame([(i, at, p) for i, at, p in left.values()] or [], "doc_id long, expires_at int, parent long")

    def purge(rows):
        bad = set()
        for r in rows:
            if r.doc_id == 13:
                bad.add(13)
                continue
            seen.append(r.doc_id)
            left.pop(r.doc_id, None)
            for i in [i for i, (_, _, p) in left.items() if p == r.doc_id]:
                left.pop(i)
        return bad

    cursor = paging.Cursor(spark, f"{tmp_path}/cursor", "expires_at int, doc_id long")
    done, failed, more = paging.sweep_expired(documents, purge, cursor, 10, pages=2)
    assert more and not failed and len(left) < 40
    done, failed, more = paging.sweep_expired(documents, purge, paging.Cursor(spark, f"{tmp_path}/cursor", "expires_at int, doc_id long"), 10)
    assert (failed, more) == ({13}, False) and set(left) <= {13, 12} and len(seen) == len(set(seen))


def test_search_page(spark):
    pages = spark.createDataFrame([(1, 1, "ann bob ann"), (1, 2, "ann"), (2, 1, "ann")], "doc_id long, page int, text string")
    rules = spark.createDataFrame([("r", "literal", "ANN", False, False, "person")], "rule_id string, kind string, pattern string, match_case boolean, whole_word boolean, category string")
    assert [r.start for r in paging.search_page(rules, pages, 1, 1).collect()] == [0, 8] and paging.search_page(rules, pages, 1, 9).count() == 0
    assert paging.search_page(rules, pages, 1, 1, 1).count() == 1
