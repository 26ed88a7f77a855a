import random

from inkspan.operators import provenance as pv

KIND = "id long, parent long, part string, name string, kind string, seq int"


def test_a_chain_of_a_thousand_takes_ten_rounds(spark):
    F = pv.F
    rows = spark.range(1025).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.when(F.col("id") == 0, F.col("id")).alias("root"), F.when(F.col("id") > 0, F.array(F.col("id"))).otherwise(F.array().cast("array<bigint>")).alias("path"))
    done, rounds = pv._doubled(rows)
    assert rounds == 10 + 1 and done.where("up is not null").count() == 0  # 1,024 steps
    assert pv._doubled(rows.where("id <= 1000"))[1] == 10
    assert done.where("id = 1024").first().path == list(range(1, 1025))


def test_folders_order_and_outcomes(spark):
    rows = [
        (1, None, None, "Box.mbox", "mbox", 0), (2, 1, "msg-9", "m", "eml", 1), (3, 1, "msg-10000", "m", "eml", 2), (4, 1, "note", "m", "txt", 3),
        (5, 3, "2.10", "a.pdf", "pdf", 4), (6, 3, "2.9", "b c.pdf", "eml", 5), (7, 6, "..x y", "c", "txt", 6), (8, 99, "1", "Box.pdf", "pdf", 7),
        (9, 9, None, "", "pdf", 8), (10, 11, "1", "x", "eml", 9), (11, 10, "1", "x", "eml", 10), (12, 11, "1", "x", "eml", 11), (13, 1, None, "y", "txt", 12),
    ]
    got = {r.id: r for r in pv.provenance(spark.createDataFrame(rows, KIND)).collect()}
    assert {i: r.outcome for i, r in got.items() if r.outcome != "part"} == {1: "root", 8: "orphan", 9: "orphan", 10: "cycle", 11: "cycle", 12: "cycle"}
    where = {i: (r.path, r.level, r.dir, r.stem) for i, r in got.items()}
    assert where[1] == ("", 0, "Box-redacted/", "Box") and where[8] == ("", 0, "", "Box-2") and where[9] == ("", 0, "", "document")
    assert where[2] == ("msg-9", 1, "Box-redacted/00010/", "message") and where[3] == ("msg-10000", 1, "Box-redacted/10001/", "message")
    assert where[4] == ("note", 1, "Box-redacted/note/", "message") and where[13] == ("13", 1, "Box-redacted/13/", "message")
    assert where[5] == ("msg-10000/2.10", 2, "Box-redacted/10001/attachments/", "2.10")
    assert where[6] == ("msg-10000/2.9", 2, "Box-redacted/10001/attachments/2.9/", "2.9")
    assert where[7] == ("msg-10000/2.9/..x y", 3, "Box-redacted/10001/attachments/2.9/attachments/", "x_y") and where[10] == (None, None, None, None)
    assert [r.id for r in sorted((r for r in got.values() if r.root == 1), key=lambda r: [tuple(p) for p in r.place])] == [1, 2, 3, 6, 7, 5, 13, 4]


def test_equals_a_walk(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, *range(max(0, i - 9), i), 10**6]) if i else None, f"{rng.randrange(3)}.{i}", f"n{i % 3}.txt", "eml", i) for i in range(400)]
    up = {r[0]: r[1] if r[1] is not None and r[1] < 400 else None for r in rows}
    want = {}
    for i, _, part, *_ in rows:
        path, at = [], i
        while up[at] is not None:
            path.insert(0, rows[at][2])
            at = up[at]
        want[i] = (at, "/".join(path), len(path))
    got = {r.id: (r.root, r.path, r.level) for r in pv.provenance(spark.createDataFrame(rows, KIND)).collect()}
    assert got == want
    assert pv.provenance(spark.createDataFrame([], KIND)).count() == 0


def test_cycles_do_not_grow_and_tables_go(spark, tmp_path, monkeypatch):
    F = pv.F
    monkeypatch.setattr("inkspan.tables.shared_folder", lambda spark: f"file://{tmp_path}")
    chain = spark.range(300).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    ring = spark.range(1000, 1500).select("id", (F.lit(1000) + (F.col("id") - 1000 + 1) % 2).alias("parent"))
    nodes = chain.unionByName(ring).select("id", "parent", F.concat(F.lit("p"), F.xxhash64("id").cast("string")).alias("part"), F.lit("a.eml").alias("name"), F.lit("mbox").alias("kind"), F.col("id").cast("int").alias("seq"))
    got = {r.id: (r.outcome, r.level) for r in pv.provenance(nodes, place=False).select("id", "outcome", "level").collect()}
    assert got[299] == ("part", 299) and got[0] == ("root", 0)
    assert {got[i] for i in range(1000, 1500)} == {("cycle", None)}
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 1_000_000
