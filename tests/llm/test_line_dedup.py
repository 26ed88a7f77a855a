import hashlib
import string

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspan.llm import line_dedup as ld

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, key_chars, documents):
    """(doc_id, text left, lines, dropped) of each row, in order."""
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= key_chars:
                held.setdefault(key(line), set()).add(d)
    gone = {k: max((x for x in own if x is not None), default=None) for k, own in held.items() if len(own) >= documents}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in gone or gone[key(x)] == d]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def got(spark, rows, key_chars, documents):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in ld.line_dedup(docs, key_chars, documents).collect()), key=str)


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rows = ld.op12_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(con.sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({ld.OP12_SQL})").fetchall())
    assert sum(r.n_dropped for r in rows) > 0


def test_defined_cases(spark):
    long = "A line of Ärger that comes again and again"
    rows = [(1, None), (2, ""), (3, "\n"), (None, long), (None, f"{long}\n{long}\nx"), *((i, f"own {i}\n  {long.upper() if i % 2 else long}\t\r\n\nend") for i in range(4, 9))]
    rows += [(8, f"{long}\nthe largest id twice"), (8, f"{long}\nthe largest id twice"), (7, f"{long}\nz"), (9, "a" * 40), (10, "b" * 39 + "\n" + "b" * 39)]
    want = brute(rows, 40, 2)
    assert got(spark, rows, 40, 2) == want and sum(w[3] for w in want) > 5
    assert got(spark, [(None, long)] * 9, 40, 2) == brute([(None, long)] * 9, 40, 2)
    assert ld.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text_and_salted_join(spark, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_KEYS", 0)
    shared = [f"shared line number {i % 50}" for i in range(20_000)]
    rows = [(i, "\n".join([*shared, f"own {i}"])) for i in range(5)]
    assert got(spark, rows, 8, 5) == brute(rows, 8, 5)


def test_all_columns_pass(spark):
    rows = [(i, "x" * 50 + "\nkept", "m", 5, "drops") for i in range(6)]
    out = ld.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, pos string, _h1 int, drops string"))
    assert out.columns == ["doc_id", "pos", "_h1", "drops", "text", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.drops, r.pos) for r in out.collect()) == [(i, "kept", "drops", "m") for i in range(5)] + [(5, "x" * 50 + "\nkept", "drops", "m")]


def test_plan_has_no_python(spark, sf):
    plan = ld.op12_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.text("aB \t\n\r\x0bÉé", max_size=24))), max_size=14))
def test_fuzz(spark, rows):
    assert got(spark, rows, 2, 2) == brute(rows, 2, 2)


def test_digest(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {d: hashlib.sha256(t.encode()).hexdigest() for d, t, _, _ in brute([(r.doc_id, r.text) for r in docs.collect()], 40, 5)}
    assert {r.doc_id: r.kept_sha256 for r in ld.op12_line_dedup(spark, sf).collect()} == texts
