import duckdb

from inkspan.llm import exact_dedup as xd


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({xd.OP8_SQL})").fetchall())
    got = sorted(tuple(r) for r in xd.op8_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_collisions_chain_and_directory_doubles(spark):
    rows = [(i, f"text {i % 40}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = xd.exact_dedup(docs, capacity=4, max_depth=6, key_bits=3).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i % 40, 3) for i in range(120)}
    assert max(r.chain for r in got) > 0
    index = xd.build_index(docs, capacity=4, max_depth=6)
    wide, cells = index.buckets, index.cells
    assert wide.select("bucket").distinct().count() > 4
    assert wide.groupBy("bucket").count().where("count > 4").count() == 0 or wide.agg({"depth": "max"}).first()[0] == 6
    deep = index.deep
    own = {(r.cell >> (deep - r.depth)) << (deep - r.depth) == r.bucket for r in cells.collect()}
    assert own == {True} and deep > 2
    assert wide.where(f"shiftrightunsigned(_key, {64 - deep}) < bucket or shiftrightunsigned(_key, {64 - deep}) >= bucket + shiftleft(1, {deep} - depth)").count() == 0


def test_probes_need_the_directory_and_compare_bytes(spark):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(120)], "doc_id long, text string")
    index = xd.build_index(docs, capacity=4, max_depth=6, key_bits=3)
    assert index.probe(docs).count() == 120 and index.buckets.where("length > 1 and body is null").count() == 0
    index.cells = index.cells.withColumn("bucket", xd.F.col("bucket") + 64)  # a wrong directory leads nowhere
    assert index.probe(docs).count() == 0
    index = xd.build_index(docs, capacity=4, max_depth=6, key_bits=3)
    index.buckets = index.buckets.withColumn("body", xd.F.lit("other"))
    assert index.probe(docs).count() == 0


def test_a_bucket_splits_only_when_overfull(spark):
    keys = [(k << 58) - (1 << 63) for k in [*range(0, 20), 40, 60]]
    entries = spark.createDataFrame([(k,) for k in keys], "_key long")
    cells, deep = xd.directory(entries, capacity=8, max_depth=6)
    got = {(r.bucket << (6 - deep), r.depth) for r in cells.collect()}
    assert deep == max(d for _, d in got)
    assert xd.directory(entries, capacity=80, max_depth=6)[1] == 0
    by = {}
    for k in keys:
        cell = (k + (1 << 64) if k < 0 else k) >> 58
        b, d = next((b, d) for b, d in got if b <= cell < b + (1 << (6 - d)))
        by.setdefault((b, d), []).append(k)
    assert all(len(v) <= 8 for v in by.values()) and set(by) == got and len({d for _, d in got}) > 1


def test_defined_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t x", "c"), (4, "  x", "d"), (4, "  x", "d"), (None, "y", None), (7, "y" * 100000, "e")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in xd.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, keep_id string")).collect()}
    assert got == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 3, True), (4, 3, 3, False), (None, None, 1, True), (7, 7, 1, True)}
    assert xd.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_rows(spark):
    rows = [(1, "a  b", "x"), (2, "a b", "y"), (2, "a b", "y"), (3, None, "z"), (4, "c", "z"), (4, "c", "z"), (None, "d", None), (5, "", "q")]
    kept = xd.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, text_sha256 string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a  b", "x"), (3, None, "z"), (4, "c", "z"), (None, "d", None)], key=str)
