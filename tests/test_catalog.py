"""Every query against its SQL, in DuckDB over the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from inkspan.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    want = con.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pass_expected_results(spark):
    for kind, s, ok in catalog.CHECKED:
        got = spark.createDataFrame([(s,)], "s string").select(catalog._CHECK[kind]("s" and catalog.c("s"))).first()[0]
        assert bool(got) == ok, (kind, s)
