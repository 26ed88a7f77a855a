import json

from pyspark.sql import functions as F

from inkspan.functions import sql
from inkspan.operators import review as rv
from inkspan.plans import analysis


def test_uncovered_and_states(spark):
    found = spark.createDataFrame([(1, 1, "email", 0, 5, "a@b.c"), (1, 1, "email", 10, 15, "A@b.c"), (1, 1, "phone", 20, 25, "12345")], "doc_id long, page int, category string, start int, end int, text string")
    red = spark.createDataFrame([(1, 1, 22, 30, "accepted"), (1, 1, 0, 3, "rejected"), (1, 1, 2, 5, "suggested")], "doc_id long, page int, start int, end int, status string")
    assert [(r.normalized, r.value, r.hits) for r in rv.find_uncovered(found, red).collect()] == [("a@b.c", "A@b.c", 1)]
    pages = spark.createDataFrame([(1, 1, "a@b.c     A@b.c     12345")], "doc_id long, page int, text string")
    values = spark.createDataFrame([(1, "a@b.c"), (1, "12345")], "doc_id long, value string")
    assert {(r.start, r.state) for r in rv.occurrence_states(values, pages, red).collect()} == {(0, "suggested"), (10, "uncovered"), (20, "accepted")}


def test_word_under_the_cursor():
    t = "Pay 4111 1111 1111 1111, or (see AB 12) mail jo.x@y.org now"
    at = lambda s: rv.word_at(t, t.index(s) + 1)
    assert t[slice(*at("1111 1111,"))] == "4111 1111 1111 1111" and t[slice(*at("see"))] == "see" and t[slice(*at("x@y"))] == "jo.x@y.org"
    assert rv.word_at("   ", 1) is None
    word = lambda t, i: (r := rv.word_at(t, i)) and t[slice(*r)]
    assert word("alpha/beta", 7) == "beta" and word("alpha/beta", 5) == "alpha" and word("x=secret;y", 4) == "secret"
    assert word("see 'it'. now", 5) == "it" and word("IBAN GB82 WEST 1234 5698 7654 32 ok", 8) == "GB82 WEST 1234 5698 7654 32"
    assert word("IBAN GB82 WEST", 1) == "IBAN" and word("a --", 3) is None and word("ab", 2) == "ab" and rv.word_at("ab", 3) is None
    assert word("y" * 700, 350) == "y" * 700


def test_preset_words_are_the_fixed_list(spark):
    rows = [("a", "SOX pack", "finds NIST numbers in a lawful way"), ("b", "Comply", "certify, regulate"), ("c", "x", "ISO 27001")]
    presets = spark.createDataFrame(rows, "id string, label string, summary string")
    assert {tuple(r) for r in rv.preset_problems(presets).collect()} == {("a", "sox"), ("a", "nist"), ("a", "lawful"), ("c", "iso 27001")}


def test_kappa_is_null_where_chance_is_certain(spark):
    from inkspan.operators import scoring

    same = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert tuple(scoring.agreement(same, "a", "b").first()) == (3, 1.0, None)


def test_columns_of_references(spark):
    text = "x\nname,Customer ID,town\nJo,KD-1,Ulm\nAl,n/a,Ulm\nBo,KD-3,Ulm\n\nend"
    pages = spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")
    at = text.index("KD-3")
    labels = spark.createDataFrame([(1, 1, at, at + 4)], "doc_id long, page int, start int, end int")
    got = rv.unlabelled_cells(pages, labels).collect()
    assert [(r.text, text[r.start : r.end]) for r in got] == [("KD-1", "KD-1")]


def test_retention(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' c, timestamp'2024-01-01 10:00:00' e, s, timestamp'2024-01-01 11:00:00' n from values (3600), (7), (86400), (39600) t(s)")
    got = df.select("s", rv.extend_retention(F.col("c"), F.col("e"), F.col("s"), F.col("n"), [3600, 39600, 86400]).alias("x")).select("s", "x.reason").collect()
    assert [tuple(r) for r in got] == [(3600, "not-an-extension"), (7, "unsupported-window"), (86400, None), (39600, "would-expire-immediately")]


def test_rules_file_round_trip(spark, tmp_path):
    rules = spark.createDataFrame([("jo smith", "literal", False, True, "person"), ("[0-9]{5}", "regex", True, False, "other")], "pattern string, kind string, match_case boolean, whole_word boolean, category string")
    (tmp_path / "r.json").write_text(rv.export_rules(rules).first().value)
    assert json.loads((tmp_path / "r.json").read_text())["version"] == 1
    assert rv.import_rules(spark, f"file://{tmp_path}/r.json", rules.limit(0)).count() == 2
    assert [r.pattern for r in rv.import_rules(spark, f"file://{tmp_path}/r.json", rules.where("kind = 'literal'")).collect()] == ["[0-9]{5}"]


def test_sources_boxes_presets(spark):
    s = "doc_id long, page int, start int, end int, category string"
    a, b = spark.createDataFrame([(1, 1, 0, 2, "x"), (1, 1, 4, 6, "x")], s), spark.createDataFrame([(1, 1, 0, 2, "x")], s)
    assert {(r.start, r.source) for r in rv.with_sources(("expansion", a), ("model", b)).collect()} == {(0, "model"), (4, "expansion")}
    words = spark.createDataFrame([(1, 1, 0, 4, 10.0, 5.0, 40.0, 8.0), (1, 1, 5, 7, 60.0, 5.0, 20.0, 8.0)], "doc_id long, page int, start int, end int, x double, y double, width double, height double")
    span = spark.createDataFrame([(1, 1, 2, 7)], "doc_id long, page int, start int, end int")
    box = rv.text_boxes(span, words).first()
    assert (box.x, box.y, box.width, box.height) == (28.5, 3.5, 53.0, 11.0)
    presets = spark.createDataFrame([("ok", "Names", "x"), ("gdpr-pack", "GDPR", "y")], "id string, label string, summary string")
    assert [tuple(r) for r in rv.preset_problems(presets).collect()] == [("gdpr-pack", "gdpr")]
    e = spark.createDataFrame([(1,), (3,), (12,)], "occurrences long")
    assert {(r.bucket, r.values, r.hits) for r in rv.expansion_by_repeat(e).collect()} == {("1", 1, 1), ("2-4", 1, 3), ("10+", 1, 12)}
    calls = spark.sql("select 'm' k, id doc_id, timestamp_seconds(id * 60) at, id ms, 10 tokens from range(1, 11)")
    assert tuple(rv.throughput(calls, ["k"]).first()) == ("m", 10, 10, 1.1111, 11.1111, 10)


def test_analysis_and_export(spark):
    docs = spark.createDataFrame([(1, "Jo Ek, 42 Larch Court\nSpringfield. Mail jo@ek.org\nJO@EK.ORG"), (2, "nothing")], "doc_id long, text string")
    model = spark.createDataFrame([(1, 1, "person", 0.8, 0, 5, "Jo Ek", "model", True), (1, 1, "address", 0.8, 22, 33, "Springfield", "model", False)], "doc_id long, page int, category string, confidence double, start int, end int, text string, reason string, everywhere boolean")
    got = {(r.category, r.text) for r in analysis.analyze(docs, model).collect()}
    assert got == {("person", "Jo Ek"), ("address", "42 Larch Court\nSpringfield"), ("email", "jo@ek.org"), ("email", "JO@EK.ORG")}
    plain = analysis.analyze(docs)
    assert plain.count() == 3
    red = analysis.to_redactions(plain).withColumn("status", F.lit("accepted")).withColumn("method", F.when(F.col("category") == "email", "tokenize")).withColumn("seq", F.monotonically_increasing_id())
    from inkspan.sources.text import paginate

    out = analysis.export(paginate(docs), red)
    assert {r.doc_id: r.redacted_text for r in out["pages"].collect()} == {1: "Jo Ek, [REDACTED]\nSpringfield. Mail EMAIL_001\nEMAIL_001\n", 2: "nothing\n"}


def test_sql_surface(spark):
    sql.register(spark)
    assert tuple(spark.sql("select luhn_valid('4111 1111 1111 1111'), iban_valid('x'), dni_valid('12345678Z'), find_all('aXaxa', 'AX')").first()) == (True, False, True, [0, 2])
    assert [r.value for r in spark.sql("select * from detect('mail jo@ek.org')").collect()] == ["jo@ek.org"]
