from inkspan.operators import review as rv
from inkspan.operators import scoring


def test_quoted_cells_of_tables(spark):
    text = 'Customer no,Name,City\n"A,1","Smith, J",X\nB-2 ,y,Z\n"say ""hi""",q,"""r"""\n\nx;Kundennummer;y\na; "K;9" ;b\n'
    got = spark.createDataFrame([(text,)], "text string").select(rv.F.explode(rv.reference_cells("text")).alias("c")).select("c.*").collect()
    assert sorted((r.header, r.value, text[r.start : r.end]) for r in got) == [("Customer no", "A,1", "A,1"), ("Customer no", "B-2", "B-2"), ("Customer no", 'say "hi"', 'say ""hi""'), ("Kundennummer", "K;9", "K;9")]


def test_tallies(spark):
    pages = spark.createDataFrame([(1, "Ann Smith lives in Rome"), (2, "x"), (3, "y y")], "doc_id long, text string")
    gold = spark.createDataFrame([(1, 0, 9, "person")], "doc_id long, start int, end int, category string")
    found = spark.createDataFrame([(1, 0, 9, "person", 0.9), (1, 0, 3, "person", 0.8), (1, 4, 9, "other", 0.9), (1, 19, 23, "address", 0.5), (3, 0, 1, "martian", 0.9), (3, 0, 1, None, 0.9), (3, 2, 3, "other", 0.9)], "doc_id long, start int, end int, category string, confidence double")
    per, others = scoring.tallies(pages, gold, found)
    assert sorted(map(tuple, per.collect())) == [(1, 2, 2, 1), (2, 0, 0, 0), (3, 1, 0, 1)]
    assert {r.category: r.unscored for r in others.collect()} == {"martian": 1, None: 1}
