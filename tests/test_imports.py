import json
import re
import time

import pytest

from inkspan.functions import fixed
from inkspan.operators import detectors, reports
from inkspan.operators import review as rv
from inkspan.operators.rules import MAX_LENGTH


def entry(pattern, **f):
    return {"pattern": pattern, "kind": "literal", "match_case": False, "whole_word": False, "category": "person"} | f


def put(tmp_path, rules, version=1):
    (tmp_path / "r.json").write_text(json.dumps({"version": version, "rules": rules}))
    return f"file://{tmp_path}/r.json"


KIND = "pattern string, kind string, match_case boolean, whole_word boolean, category string"


def test_outcomes_of_a_rule_file(spark, tmp_path):
    known = spark.createDataFrame([("ann", "literal", None, False, "person"), ("ann", "regex", False, False, "person")], KIND)
    path = put(tmp_path, [entry("ann"), entry("ann", category="other", enabled=False), entry("bob"), entry("bob"), entry("bob", match_case=True), entry("(", kind="regex"), entry("(", kind="regex"), entry("a  b", kind="regex"), entry("a b", kind="regex")])
    rows = rv.sorted_entries(rv.read_rule_file(spark, path), known).orderBy("seq").collect()
    assert [r.outcome for r in rows] == ["duplicate", "new", "new", "duplicate", "new", "invalid", "invalid", "new", "new"] and rows[5].problem and not rows[0].problem
    new = rv.import_rules(spark, path, known).collect()
    assert [(r.seq, r.enabled) for r in new] == [(1, False), (2, True), (4, True), (7, True), (8, True)]
    with pytest.raises(rv.RuleFileError):
        rv.import_rules(spark, path, known, cap=6)  # all or none
    assert len(rv.import_rules(spark, path, known, cap=7).collect()) == 5


@pytest.mark.parametrize("rules", [[entry("x")] * (rv.RULE_CAP + 1), [entry("")], [entry("x" * (MAX_LENGTH + 1))], [entry("x", category=None)], [entry("x", kind="other")], None])
def test_refused_files(spark, tmp_path, rules):
    with pytest.raises(rv.RuleFileError):
        rv.read_rule_file(spark, put(tmp_path, rules))


def test_another_version_is_refused(spark, tmp_path):
    with pytest.raises(rv.RuleFileError):
        rv.read_rule_file(spark, put(tmp_path, [entry("x")], 2))


def test_addresses_equal_the_pattern_and_are_linear():
    pattern = re.compile(fixed.PATTERNS["email-address"])
    import random

    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choices("aB1@@..- é_\n", k=rng.randrange(30)))
        assert list(detectors._addresses(t)) == [m.span() for m in pattern.finditer(t)], t
    began = time.time()
    assert [s["text"] for s in detectors.detect_text("x" * 3_000_000 + " a@b.cc", detectors=["email-address"])] == ["a@b.cc"]
    assert time.time() - began < 5


def test_languages_only_where_needed(spark):
    pages = spark.createDataFrame([(1, 1, "mail a@b.cc 4111 1111 1111 1111")], "doc_id long, page int, text string")
    plan = lambda *names: detectors.detect(pages, list(names))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan("email-address", "payment-card") and "regexp_extract_all" in plan("phone-number")
    assert {r.detector for r in detectors.detect(pages, ["email-address", "payment-card"]).collect()} == {"email-address", "payment-card"}


def test_unknown_reasons_end_the_report(spark):
    docs = spark.createDataFrame([(1, 1, "lost")], "batch_id long, doc_id long, reason string")
    none = spark.createDataFrame([], "doc_id long, category string, style string, method string, count long")
    with pytest.raises(Exception, match="no reason to skip: lost"):
        reports.batch_outcomes(docs, none, none.select("doc_id", "count")).collect()
    got = reports.batch_outcomes(docs.limit(0), none, none.select("doc_id", "count")).collect()
    assert got == []
