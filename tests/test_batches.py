import pyarrow as pa

from inkspan import batches as bt
from inkspan.operators import detectors, matching, redact, rules
from inkspan.sources import atoms, text


def test_pieces_hold_all_rows_in_order():
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, None, "b" * 50, "", "c" * 4, "d" * 7])], names=["i", "t"])
    got = list(bt.pieces(iter([b, b.slice(0, 0)]), 1, 10))
    assert [p.column(0).to_pylist() for p in got] == [[0, 1], [2], [3, 4], [5]]
    assert list(bt.cut([])) == [] and list(bt.cut([99], 1)) == [(0, 1)]


def passed(df_method, frame, monkeypatch):
    """The function given to mapInArrow, run over one large batch."""
    seen, real = {}, type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: (seen.setdefault("f", f), real(self, f, schema))[1])
    df_method()
    return seen["f"]


def test_no_step_makes_a_large_batch_whole(spark, monkeypatch):
    n, body = 400, ("call +34 600 111 222 or a@b.example the eau " * 200)[:8000]
    frame = spark.createDataFrame([(1, 1, "x")], "doc_id long, page int, text string")
    whole = {"page": pa.array([1] * n, pa.int32()), "doc": pa.array(range(n), pa.int64()), "text": pa.array([body] * n)}
    langs = pa.array([["en"]] * n, pa.list_(pa.string()))
    rule = spark.createDataFrame([("r", "literal", "the", False, False, "other")], "rule_id string, kind string, pattern string, match_case boolean, whole_word boolean, category string")
    cases = {
        "paginate": (lambda: text.paginate(frame), [whole["doc"], whole["text"]]),
        "detect": (lambda: detectors.detect(frame.selectExpr("*", "array('en') as l"), ["email-address"], "l"), [whole["doc"], whole["page"], whole["text"], langs]),
        "find_matches": (lambda: rules.find_matches(rule, frame), [whole["doc"], whole["page"], whole["text"]]),
    }
    for name, (make, columns) in cases.items():
        with monkeypatch.context() as m:
            f = passed(make, frame, m)
        out = list(f(iter([pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])])))
        assert len(out) > 2 and max(b.nbytes for b in out) < 4 * bt.PIECE, name


def test_places_do_not_copy_a_long_text_for_every_place_at_once(spark):
    body, n = "eau " * 5_000, 5_000
    docs = spark.createDataFrame([(1, body)], "doc_id long, text string")
    values = spark.createDataFrame([(1, "eau")], "doc_id long, value string")
    assert redact.verify(docs, spark.createDataFrame([(1, "eau ")], "doc_id long, value string")).collect() == [(1, "eau ")]
    assert matching.value_places(docs, values, keep=["doc_id"]).count() == n
    assert matching.value_places(docs, values).count() == n  # 100 MB of text in all: by pieces


def test_read_html_is_what_the_column_says(spark):
    docs = spark.createDataFrame([(1, "<p title='t'>A &amp; b<br>c  d</p>"), (2, None), (3, "")], "doc_id long, html string")
    want = {r.doc_id: r._h for r in docs.select("doc_id", atoms.html_atoms("html").alias("_h")).collect()}
    assert {r.doc_id: r._h for r in atoms.read_html(docs).collect()} == want


def test_asked_detectors_are_chosen_once_and_find_the_same():
    body = "call +34 600 111 222 or a@b.example"
    chosen = detectors._chosen(("email-address",))
    assert [d[0] for d in chosen] == ["email-address"] and detectors._chosen(("email-address",)) is chosen
    one = [d for d in detectors.detect_text(body) if d["detector"] == "email-address"]
    assert [(d["start"], d["end"]) for d in detectors.detect_text(body, detectors=["email-address"])] == [(d["start"], d["end"]) for d in one] == [(24, 35)]
