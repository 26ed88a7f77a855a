import zlib

import numpy as np

from inkspan.llm import language_id as li


def test_held_out_accuracy_and_contract(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = li.op6_language(spark, d).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert np.mean(right) > 0.97, np.mean(right)


def test_families_come_first():
    rows = [(k, li.features(t)) for k, t in [("de", "schön und der"), ("en", "the and thing"), ("fr", "eau le la"), ("es", "ción los las")] * 3]
    m = li.Model(rows)
    assert set(m.pairs) == {("de", "en"), ("es", "fr")} and len(m.by_family) == 2
    assert m.predict("the thing and the")[0] == "en" and m.predict("la eau le")[0] == "fr"


def test_accept_without_labels(spark):
    """No label outside the held-out fold: nothing is learnt, and texts with a letter stay."""
    rows = [(i, t, None) for i, t in enumerate(["hello there", None, "12 --", "", "das ist"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in li.accept(docs, li.train(docs)).collect()) == [0, 4]


def test_defined_cases(spark):
    rows = [(1, "hello there", "en", 1), (2, None, "en", 1), (3, "12 ½ ² --", None, 1), (4, "", "de", 1), (None, "das ist", "de", 1), (3, "x" * 3_000_000, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in li.predict(docs, li.train(docs)).collect()))
    assert [k for k in got if k[1] == "und"] == [(2, "und"), (3, "und"), (4, "und")]
    bare = docs.withColumn("lang", docs.lang.substr(9, 0)).where("false")
    assert li.predict(bare, li.train(bare)).count() == 0
    assert li.Model([]).predict("abc") == ("und", 0.0)


def test_accept_uses_the_prediction(spark, sf):
    """A plain loop over the model: und and low scores go, null languages are filled, all else stays as it is."""
    from inkspan.llm import language_id as li

    rows = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(9001, None, "en", "s", 0), (9002, "12 34 !", None, "s", 7), (9003, "", "en", "s", 0), (9004, "\u0430\u0431\u0432 \u0433\u0434\u0435 \u0436\u0437\u0438 " * 20, "ru", "s", 1), (9005, rows.where("lang = 'de'").first().text, None, "s", 1), (9006, rows.where("lang = 'en'").first().text, None, None, None)]
    docs = rows.unionByName(spark.createDataFrame(extra, rows.schema))
    model = li.train(rows)
    got = {r.doc_id: r for r in li.accept(docs, model).collect()}
    want = {}
    for r in docs.collect():
        lang, score = model.predict(r.text)
        if lang != "und" and (score >= li.LEAST or sum(map(str.isalpha, r.text)) < li.LETTERS):
            want[r.doc_id] = r.asDict() | {"lang": r.lang or lang}
    assert {k: v.asDict() for k, v in got.items()} == want
    assert not {9001, 9002, 9003, 9004} & set(got) and got[9005].lang == "de" and got[9006].lang == "en"
    clean = {r.doc_id for r in rows.collect() if r.text and any(map(str.isalpha, r.text))}
    assert clean <= set(got)


def test_accept_without_labels_keeps_all_with_a_letter(spark):
    from inkspan.llm import language_id as li

    docs = spark.createDataFrame([(1, "a text", None), (2, None, None), (3, "12", None), (4, "\u00e9", None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, li.accept(docs, li.train(docs)).collect())) == [(1, "a text", None), (4, "\u00e9", None)]


def test_svm_separates_like_a_plain_loop():
    """Dual coordinate descent reaches the optimum of the primal objective that a plain gradient descent finds."""
    import numpy as np

    from inkspan.llm import language_id as li

    rng = np.random.Generator(np.random.PCG64(4))
    x = rng.normal(size=(80, 6)).astype(np.float32)
    y = np.where(x @ rng.normal(size=6) + 0.3 * rng.normal(size=80) > 0, 1, -1)
    w = li.linear_svm(x, y, c=1.0, epochs=300).astype(float)
    z = np.hstack([x, np.ones((80, 1))])

    def objective(v):
        return 0.5 * v @ v + (np.maximum(0, 1 - y * (z @ v)) ** 2).sum()

    v = np.zeros(7)
    for _ in range(20000):
        slack = np.maximum(0, 1 - y * (z @ v))
        v -= 0.002 * (v - 2 * z.T @ (y * slack))
    assert abs(objective(w) - objective(v)) < 1e-3 * objective(v)
