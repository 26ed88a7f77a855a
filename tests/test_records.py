import json

from inkspan.operators import records as rc

KIND = rc.STORED.rsplit(", ", 1)[0] + f", box {rc.BOX}, notes map<string,string>"


def test_stored_rows_round_trip(spark):
    rows = [
        ("a", 1, "ai", "text", "person", 0.9, "suggested", "mask", 1, 'Ann "x"', 0, 3, None, None, None, "why", None, None, None),
        ("b", 1, "user", "region", "face", None, "accepted", None, 2, None, None, None, None, None, None, None, "r1", (1.0, 2.5, 3.0, 4.0), {"global": "true", "k": 'q"}'}),
        ("c", 2, "rule", "cell", "other", 1.0, "rejected", "tokenize", None, "v", None, None, "Data", 3, 4, "", None, (0.0, 0.0, 1.0, 1.0), {}),
    ]
    df = spark.createDataFrame(rows, KIND)
    stored = rc.to_stored(df)
    assert {r.id: json.loads(r.metadata) for r in stored.collect()} == {"a": {}, "b": {"global": "true", "k": 'q"}', "box": {"x": 1.0, "y": 2.5, "width": 3.0, "height": 4.0}}, "c": {"box": {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}}}
    back = {r.id: r for r in rc.from_stored(stored).collect()}
    for r in df.collect():
        assert back[r.id][:-2] == r[:-2] and back[r.id].box == r.box and back[r.id].notes == (r.notes or {})
    odd = stored.limit(1).withColumn("method", rc.F.lit("shred")).withColumn("metadata", rc.F.lit("[not"))
    assert rc.from_stored(odd).first()[-2:] == (None, {}) and rc.from_stored(odd).first().method is None


def test_decisions_leave_what_is_decided(spark):
    kind = "doc_id long, seq long, category string, text string, status string, source string, confidence double, reason string, page int"
    rows = [(1, 1, "person", "Ann", "suggested", "ai", 0.9, "r", 1), (1, 2, "person", " ann ", "rejected", "user", 1.0, "", 2), (1, 3, "person", "ANN", "suggested", "ai", 0.8, "", 2), (1, 4, "face", None, "suggested", "ai", 0.8, "", 9), (2, 5, "person", "Ann", "suggested", "ai", 0.8, "", 1)]
    df = spark.createDataFrame(rows, kind)
    got = {r.key: r for r in rc.suggestions(df.where("doc_id = 1"), None).collect()}
    assert (got["person|ann"].count_ if hasattr(got["person|ann"], "count_") else got["person|ann"]["count"]) == 3 and got["person|ann"].text == "Ann" and got["person|ann"].pages == [1, 2] and got["face|face"].text == "face"
    assert rc.suggestions(df, "suggested", "person", "ai").count() == 2
    groups = spark.createDataFrame([(1, "person|ann"), (1, "no|such"), (2, "face|face")], "doc_id long, key string")
    after, counts = rc.decide(df, groups, "accepted")
    assert {r.seq: r.status for r in after.collect()} == {1: "accepted", 2: "rejected", 3: "accepted", 4: "suggested", 5: "suggested"} and after.columns == df.columns
    assert counts.collect() == [(1, 2, 1)]


def test_short_surrogates(spark):
    kinds = spark.createDataFrame([("pdf",), ("image",), ("csv",), (None,)], "k string")
    assert [r[0] for r in kinds.select(rc.short_surrogate(rc.F.col("k"))).collect()] == [True, True, False, False]
