import duckdb

from inkspan.llm import warc


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    cols = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = sorted(con.sql(f"select {cols} from ({warc.OP5_SQL})").fetchall())
    got = sorted(tuple(r) for r in warc.op5_warc_revisits(spark, sf).select(*cols.split(", ")).collect())
    assert got == want


def test_defined_cases(spark, tmp_path):
    long = "<p>WARC/1.1\r\n\r\nünï</p>" * 40
    rows = [(1, "u", long, 1), (2, None, long, 2), (3, "a\r\nb", "short", 3), (4, "u", "short", 4), (5, "u", None, 5), (None, "u", "n" * 200, 6), (7, "u", long + "\r\n", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.join_revisits(warc.read_archives(spark, f"file://{tmp_path}/w")).collect()}
    n = len(long.encode())
    assert got == {(1, n, "response", None), (2, n, "revisit", 1), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (None, 200, "response", None), (7, n + 2, "response", None)}
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.join_revisits(warc.read_archives(spark, f"file://{tmp_path}/e")).count() == 0


def test_parser_reads_plain_archives():
    r = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse_records(r * 3)] == [b"abc"] * 3
