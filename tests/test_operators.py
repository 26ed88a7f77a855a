"""Rules, redaction, reports and streams on small inputs."""

import pytest
from pyspark.sql import functions as F

from inkspan.functions import text as tx
from inkspan.operators import detectors, redact, reports, review, rules, scoring
from inkspan.plans import catalog
from inkspan.sources.text import delimited_cells
from inkspan.streaming import events as ev

RULE = "rule_id string, kind string, pattern string, match_case boolean, whole_word boolean, category string"


@pytest.mark.parametrize("bad", ["", "  ", "a" * 501, "(", "(a)\\1", "foo(?=bar)", "(?<!a)b", "x*"])
def test_patterns_are_refused(bad):
    with pytest.raises(rules.PatternError):
        rules.compile_pattern(bad, "regex")


def test_matches_and_budgets(spark):
    pages = spark.createDataFrame([(1, 1, "John Smith, john smithson\nJOHN"), (2, 1, "a" * 400 + "!"), (3, 1, None)], "doc_id long, page int, text string")
    made = spark.createDataFrame([("w", "literal", "john", False, True, "person"), ("c", "literal", "John", True, False, "person"), ("m", "regex", "^[A-Z]+$", True, False, "other"), ("slow", "regex", "(a|aa)+$", True, False, "other"), ("many", "literal", "a", False, False, "other")], RULE)
    hits, failed = rules.find_matches(made, pages, max_matches=100, seconds=0.3)
    got = {}
    for r in hits.collect():
        got.setdefault(r.rule_id, []).append((r.doc_id, r.start, r.text))
    assert sorted(got["w"]) == [(1, 0, "John"), (1, 12, "john"), (1, 26, "JOHN")] and got["c"] == [(1, 0, "John")] and got["m"] == [(1, 26, "JOHN")]
    assert {(r.rule_id, r.doc_id, r.reason) for r in failed.collect()} == {("slow", 2, "time"), ("many", 2, "matches")}
    counts, samples = rules.search_summary(hits.where("rule_id = 'w'"), pages)
    assert counts.first().hits == 3 and samples.orderBy("start").first() == (1, 1, 0, 4, "", "John", " Smith, john smithson JOHN")
    diff = rules.diff_matches(hits.where("rule_id = 'w'"), hits.where("rule_id = 'c'"))
    assert {(r.start, r.change) for r in diff.collect()} == {(12, "lost"), (26, "lost")}


def test_queries_give_all_matches(spark, tmp_path):
    """More hits than 10,000 in a document; a time limit only where it is asked for, and then with its row."""
    text = "the and und " * 10_001 + 'token = "' + "a" * 40 + '"'
    spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q, d = catalog.QUERIES, str(tmp_path)
    assert {tuple(r) for r in q["batch_search"](spark, d).collect()} == {(1, 10_001), (2, 0)}
    assert {tuple(r) for r in q["rule_matches"](spark, d).collect()} == {("r1", 1, 10_001), ("r2", 1, 1)}
    assert {tuple(r) for r in q["rule_redactions"](spark, d).groupBy("rule_id").count().collect()} == {("r1", 10_001), ("r2", 1), ("r3", 10_001)}
    assert [(r.doc_id, r.start) for r in q["search_samples"](spark, d).collect()] == [(1, 120_012)]
    pages = spark.createDataFrame([(1, 1, "a" * 27 + "!")], "doc_id long, page int, text string")
    slow = spark.createDataFrame([("slow", "regex", "(a|aa)+$|!", True, False, "other")], RULE)
    hits, failed = rules.find_matches(slow, pages)
    assert [(r.start, r.end) for r in hits.collect()] == [(27, 28)] and failed.count() == 0
    hits, failed = rules.find_matches(slow, pages, seconds=0.001)
    assert hits.count() == 0 and [(r.rule_id, r.reason) for r in failed.collect()] == [("slow", "time")]


def test_limits_are_not_silent(spark):
    chain = spark.createDataFrame([(i, i - 1 or None, str(i)) for i in range(1, 7)], "id long, parent long, name string")
    assert sorted((r.level, r.path) for r in reports.tree_paths(chain).collect()) == [(i, "/".join(map(str, range(1, i + 2)))) for i in range(6)]
    many = spark.createDataFrame([(str(i), "literal", False, False, "other") for i in range(201)], "pattern string, kind string, match_case boolean, whole_word boolean, category string")
    with pytest.raises(ValueError, match="200"):
        review.export_rules(many)
    with pytest.raises(Exception, match="over 2048 columns"):
        delimited_cells(spark.createDataFrame([(1, "," * 2048 + "x")], "doc_id long, text string")).collect()


def test_recall_interval_has_all_rounds(spark, sf):
    per = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("hit"), F.lit(1).alias("total"))
    want, few = (scoring.bootstrap(per, "hit", "total", rounds=n).first() for n in (2000, 200))
    assert catalog.QUERIES["recall_interval"](spark, sf).first() == want != few


RED = "doc_id long, seq long, type string, text string, category string, method string, status string, source string"


def test_redaction_round_trip(spark):
    text = "Jo Ek met jo  ek and Al Bo at x@y.zz."
    pages = spark.createDataFrame([(1, text)], "doc_id long, text string")
    own = spark.createDataFrame([(1, 1, "text", "Jo Ek", "person", "tokenize", "accepted", "user"), (1, 2, "text", "jo  ek", "person", "pseudonymize", "accepted", "user"), (1, 3, "text", "Al Bo", "person", "tokenize", "accepted", "rule"), (1, 4, "text", "x@y.zz", "email", None, "accepted", "ai"), (1, 5, "text", "met", "other", None, "suggested", "ai")], RED)
    named = redact.surrogates(own)
    by = {r.normalized: (r.method, r.surrogate) for r in named.collect()}
    assert by == {"jo ek": ("pseudonymize", "PERSON_002"), "al bo": ("tokenize", "PERSON_001"), "x@y.zz": ("mask", None)}
    places = spark.createDataFrame([(1, 0, 5, "PERSON_002"), (1, 10, 16, "PERSON_002"), (1, 21, 26, "PERSON_001"), (1, 30, 36, None), (1, 33, 36, "EMAIL_001")], "doc_id long, start int, end int, replacement string")
    out = redact.cut_text(pages, places, ["doc_id"])
    assert out.first().redacted_text == "PERSON_002 met PERSON_002 and PERSON_001 at [REDACTED]."
    values = redact.accepted_values(own)
    clean = out.select("doc_id", F.col("redacted_text").alias("text"))
    redact.assert_clean(redact.verify(clean, values, named))
    assert redact.verify(pages, values).count() == 4
    with pytest.raises(redact.ExportVerificationError):
        redact.assert_clean(redact.verify(pages, values))
    back = redact.restore(clean, redact.vault(named)).first()
    assert back.outcome == "ok" and back.restored_text == "PERSON_002 met PERSON_002 and Al Bo at [REDACTED]."
    key = F.lit("0123456789abcdef")
    sealed = spark.range(1).select(redact.encrypt_inline(F.lit("Jo Ek"), key).alias("t"))
    assert sealed.select(redact.decrypt_inline(F.col("t"), key)).first()[0] == "Jo Ek"


def test_cells(spark):
    cells = spark.createDataFrame([(1, 1, 1, "name"), (1, 1, 2, "mail"), (1, 2, 1, "Jo (x)"), (1, 2, 2, "a@b.cc"), (1, 3, 1, "see jo (X) there"), (1, 3, 2, "")], "doc_id long, row int, col int, value string")
    orders = spark.createDataFrame([(1, "column", None, 2)], "doc_id long, type string, row int, col int")
    values = spark.createDataFrame([(1, "Jo (x)")], "doc_id long, value string")
    got = {(r.row, r.col): r.redacted for r in redact.redact_cells(cells, orders, values).collect()}
    assert got == {(1, 1): "name", (1, 2): "mail", (2, 1): "[REDACTED]", (2, 2): "[REDACTED]", (3, 1): "see [REDACTED] there", (3, 2): ""}


def test_reports_and_verdicts(spark):
    r = spark.createDataFrame([(1, "total 3"), (2, "found Jo Smith")], "doc_id long, report string")
    v = spark.createDataFrame([(1, "Jo Smith"), (2, "jo smith")], "doc_id long, value string")
    assert [x.doc_id for x in reports.leaking_reports(r, v).collect()] == [2]
    cells = spark.createDataFrame([(1, 1, 1, "h"), (1, 2, 1, "a"), (1, 3, 1, ""), (1, 4, 1, "b")], "doc_id long, row int, col int, value string")
    assert reports.column_samples(cells).first() == (1, 1, "h", 2, "a|b")
    d = spark.createDataFrame([(1, 0.6), (2, 0.6), (3, 0.6)], "doc_id long, confidence double")
    seen = spark.createDataFrame([(1, False, None), (2, True, 0.9)], "doc_id long, sensitive boolean, new_confidence double")
    assert {(x.doc_id, x.confidence) for x in detectors.merge_verdicts(d, seen, ["doc_id"]).collect()} == {(2, 0.9), (3, 0.6)}
    s = spark.createDataFrame([(5.0, 10.0), (8.0, 10.0), (10.0, 10.0), (1.0, None)], "a double, b double")
    assert [x[0] for x in s.select(reports.spend_status(F.col("a"), F.col("b"))).collect()] == ["ok", "near", "reached", "none"]


def test_attribution(spark):
    pages = spark.createDataFrame([(1, "abcdefghij")], "doc_id long, text string")
    gold = spark.createDataFrame([(1, 0, 2), (1, 3, 5), (1, 6, 8), (1, 8, 9)], "doc_id long, start int, end int")
    found = spark.createDataFrame([(1, 0, 2, "model"), (1, 0, 2, "patterns"), (1, 3, 4, "model"), (1, 4, 5, "patterns"), (1, 6, 8, "expansion")], "doc_id long, start int, end int, source string")
    assert {r.start: r.credit for r in scoring.attribute(gold, found, pages).collect()} == {0: "patterns", 3: "together", 6: "expansion", 8: None}


def test_text_kernel(spark):
    df = spark.createDataFrame([("  Ab\t\n c ", "10 MiB", "a.b"), ("x", "nope", "+")], "s string, size string, r string")
    got = df.select(tx.normalize_value(F.col("s")), tx.byte_size(F.col("size")), tx.escape_regex(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("ab c", 10 << 20, "a\\.b"), ("x", None, "\\+")]
    langs = spark.createDataFrame([("The cat is in the house and it is with the dog for that",), ("der Hund und die Katze ist nicht mit den Kindern",), ("hola",)], "t string").select(tx.guess_language(F.col("t")).alias("g")).select("g.*", tx.describe_language(F.col("g.language"), F.col("g.detected")))
    assert [tuple(r) for r in langs.collect()] == [("en", True, None), ("de", True, "read as German"), ("en", False, "language not recognised, read as English")]


def stream_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_streams_equal_batches(spark, sf, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").limit(200)
    s = stream_of(spark, tmp_path, rows.collect(), EVENT)
    for name, make, mode in (("latest", ev.latest_state, "complete"), ("hours", ev.tumbling_counts, "complete"), ("buckets", None, "append"), ("once", ev.once, "append")):
        df = make(s) if make else ev.token_bucket_stream(s)
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        want = ev.token_buckets(rows) if name == "buckets" else rows if name == "once" else make(rows)
        assert sorted(map(str, spark.table(name).select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_rules_reach_later_documents(spark, tmp_path):
    s = stream_of(spark, tmp_path, [(1, 1, "call Jo"), (2, 1, "nothing")], "doc_id long, page int, text string")
    made = spark.createDataFrame([("r", "literal", "jo", False, True, "person")], RULE)
    seen = []
    q = ev.carry_to_arrivals(s, lambda: made, lambda df, epoch: seen.extend(df.collect()), f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.doc_id, r.status, r.text) for r in seen] == [(1, "accepted", "Jo")]


@pytest.mark.parametrize(
    "values, want",
    [
        (["EMP-00123", "EMP-00456", "EMP-00789"], [("EMP-00\\d{3}", "EMP-00xxx")]),
        (["KD-1", "KD-22", "AB-333"], []),
        (["A 12", "A 123", "A 129"], [("A\\s+12\\d{0,1}", "A 12x")]),
        (["a1b-22222", "é1c-33333", "z1d-44444"], [("\\p{L}1[a-z]-\\d{5}", "a1b-22222")]),
        (["a", "b", None, ""], []),
        (["x|1111", "x|2222", "x|2222"], []),
    ],
)
def test_shapes_keep_what_never_varies(spark, values, want):
    import regex

    df = spark.createDataFrame([(i, "text", "user", "accepted", v, "x") for i, v in enumerate(values)], "seq int, type string, source string, status string, text string, category string")
    got = [(r.pattern, r.display) for r in rules.learn_shapes(df).collect()]
    assert got == want
    assert all(regex.fullmatch(p, v) for p, _ in got for v in values)
    known = spark.createDataFrame([(p,) for p, _ in want], "pattern string")
    assert rules.learn_shapes(df, known=known).count() == 0
    assert rules.learn_shapes(df.withColumn("source", F.lit("rule"))).count() == 0


def test_scores_by_category_and_cutoff(spark):
    pages = spark.createDataFrame([(1, "call Anna  Berg now, x@y.zz or  z")], "doc_id long, text string")
    gold = spark.createDataFrame([(1, 5, 15, "person"), (1, 21, 27, "email"), (1, 31, 33, "person")], "doc_id long, start int, end int, category string")
    found = spark.createDataFrame([(1, 5, 19, "person", 0.9), (1, 5, 9, "person", 0.8), (1, 21, 27, "person", 0.6), (1, 28, 30, "email", 0.7), (1, 0, 4, None, 0.9)], "doc_id long, start int, end int, category string, confidence double")
    lures = spark.createDataFrame([(1, 27, 30), (1, 21, 22)], "doc_id long, start int, end int")
    labels, kept = scoring.score_documents(pages, gold, found, negatives=lures)
    assert {r.start: (r.covered, r.overlap, r.exact, r.strict) for r in labels.collect()} == {5: (True, True, False, True), 21: (True, True, True, False), 31: (False, False, False, False)}
    assert {r.start: (r.value, r.correct, r.strict, r.negative) for r in kept.collect()} == {5: ("anna berg now", True, True, False), 21: ("x@y.zz", True, False, False), 28: ("or", False, False, True)}
    every = scoring.aggregate(labels, kept).where("category is null").first()
    assert (every.precision, every.strict_precision, every.recall, every.strict_recall, every.negative_hits) == (0.6667, 0.3333, 0.6667, 0.3333, 1)
    nothing = scoring.aggregate(labels, kept.where("false")).where("category is null").first()
    assert (nothing.precision, nothing.recall, nothing.f1) == (None, 0.6667, None)
    assert scoring.aggregate(labels.where("false"), kept.where("false")).count() == 0
    at = {r.cutoff: (r.detections, r.precision, r.recall) for r in scoring.by_cutoff(pages, gold, found).collect()}
    assert at == {0.5: (3, 0.6667, 0.6667), 0.7: (2, 0.5, 0.3333), 0.8: (1, 1.0, 0.3333), 0.9: (1, 1.0, 0.3333)}
    unsure = found.withColumn("confidence", F.when(F.col("start") > 5, F.col("confidence")))
    assert scoring.by_cutoff(pages, gold, unsure).count() == 0


def test_export_counts_are_dealt_by_rows_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(reports, "COUNTED", 1_000, raising=False)
    rows = spark.range(8_000).select((F.col("id") % 2_000).alias("doc_id"), F.lit("accepted").alias("status"), F.lit("person").alias("category"), F.lit("ai").alias("source"), F.lit(False).alias("boxed"))
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("txt").alias("kind"), F.lit(False).alias("narrowed"))
    out = reports.export_counts(rows, docs, F.lit("mask"))
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 8_000 and max(tasks) < 1_600  # 2,000 and more in one of four tasks
    assert out.groupBy("section", "key").agg(F.sum("count")).count() == 4 and out.where("count != 4").count() == 0


def test_cost_of_labels_and_detections_makes_no_pairs(spark, sf):
    import contextlib
    import io

    df = catalog.missed_cost(spark, sf)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        df.explain()
    assert plan.getvalue().count("Exchange hashpartitioning") <= 10 and "_bin" not in plan.getvalue()  # 33 with pairs
