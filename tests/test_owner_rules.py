from datetime import datetime

from inkspan.streaming import owner_rules as orr

KIND = "owner string, event string, rule_id string, pattern string, doc_id long, at timestamp"


def day(n, hour=0):
    return datetime(2024, 1, n, hour)


def test_a_used_rule_lives_on_and_an_idle_one_ends(spark, tmp_path):
    orr.use_state_store(spark)
    batches = [
        [("o", "rule", "used", "ann", None, day(1)), ("o", "rule", "idle", "bob", None, day(1)), ("p", "rule", "other", "x", None, day(2))],
        [("o", "document", None, None, 1, day(3)), ("o", "remove", "idle2", None, None, day(3))],
        [("o", "rule", "late", "zed", None, day(4)), ("p", "document", None, None, 9, day(4))],
        [("o", "document", None, None, 2, day(7)), ("o", "remove", "late", None, None, day(6))],
        [("o", "document", None, None, 3, day(11)), ("o", "document", None, None, 4, day(20))],
        [("q", "document", None, None, 5, day(28))],
    ]
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{source}/b={i}")
    for i, rows in enumerate(batches):  # one file a micro-batch, in order
        (tmp_path / "flow").mkdir(exist_ok=True)
        part = next((source / f"b={i}").glob("*.parquet"))
        target = tmp_path / "flow" / f"{i}.parquet"
        target.write_bytes(part.read_bytes())
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flow"))
        q = orr.owner_rule_stream(stream, idle_ms=5 * 24 * 3600 * 1000).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()  # each run starts from the state of the one before
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("owner", "event", "rule_id", "doc_id").collect()]
    applied = sorted((o, r, d) for o, e, r, d in got if e == "applied")
    # both rules apply on day 3 and live until day 8; day 7 renews them to day 12, day 11 to day 16
    assert applied == [("o", "idle", 1), ("o", "idle", 2), ("o", "idle", 3), ("o", "used", 1), ("o", "used", 2), ("o", "used", 3), ("p", "other", 9)]
    ended = sorted((o, r) for o, e, r, _ in got if e == "ended")
    assert ended == [("o", "idle"), ("o", "used"), ("p", "other")]
