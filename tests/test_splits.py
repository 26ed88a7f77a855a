import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspan.sources import markup, splits, text


def pieces(spark, docs, cut):
    rows = [(d, i, t[a:z]) for d, t in docs.items() for i, (a, z) in enumerate(cut(t))]
    return spark.createDataFrame(rows, "doc_id long, seq int, text string")


def every(n):
    return lambda t: [(i, i + n) for i in range(0, max(1, len(t)), n)]


def one_pass(docs, delimiter=","):
    """Cells and refused documents by the parser that holds a text whole."""
    out, refused = [], {}
    for d, t in docs.items():
        try:
            grid = text.parse_delimited_text(t.removeprefix("﻿"), delimiter)
        except ValueError as e:
            refused[d] = str(e)
            continue
        out += [(d, r + 1, c + 1, v, q) for r, row in enumerate(grid) for c, (v, q) in enumerate(row[: text.MAX_COLUMNS]) if v]
    return sorted(out), refused


def check(spark, docs, cut, delimiter=","):
    grids = splits.Grids(pieces(spark, docs, cut), delimiter)
    cells, refused = one_pass(docs, delimiter)
    assert sorted(map(tuple, grids.cells().select("doc_id", "row", "col", "value", "quoted").collect())) == cells
    assert {r.doc_id: r.reason for r in grids.grids.where("reason is not null").collect()} == refused
    about = {r.doc_id: (r.rows, r.columns) for r in grids.grids.where("reason is null").collect()}
    for d, t in docs.items():
        if d not in refused:
            grid = text.parse_delimited_text(t.removeprefix("﻿"), delimiter)
            assert about[d] == (len(grid), max(map(len, grid), default=0)), (d, t)


TEXTS = {
    1: 'name,email\r\n"Smith, J","a ""q"" b"\nx,,z\r"multi\r\nline",1', 2: "", 3: 'a"b,c"\r\n"x"y",z\n', 4: '"never closed,\n1,2', 5: "﻿\"q\",1\r\n", 6: "a,﻿b\n﻿c",
    15: "﻿", 7: '"' + 'long "" text, \n' * 30 + '",end\r\r\n\n,', 8: ",,,\n\n\r\r\n", 9: '""""', 10: '""x,"" y\n"z"', 11: "é,ü\n\"ß,\"\"ñ\"\n", 12: '"a""', 13: "\r\nx", 14: "one",
}


@pytest.mark.parametrize("n", [1, 2, 7, 10_000])
def test_cells_equal_the_one_pass_parser_at_any_split(spark, n):
    check(spark, TEXTS, every(n))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text('a",\n\r﻿é', max_size=30), min_size=1, max_size=12), st.integers(1, 6), st.randoms())
def test_fuzz(spark, texts, n, rng):
    def cut(t):
        at = sorted({0, *(rng.randint(0, len(t)) for _ in range(n)), len(t)})
        return list(zip(at, at[1:], strict=False)) or [(0, 0)]

    check(spark, dict(enumerate(texts)), cut)


@given(st.text('a",\n\rb', max_size=40))
def test_maps_are_what_a_walk_from_each_state_gives(t):
    stop = re.compile("[,\r\n]")
    for state, got in enumerate(splits.maps(t, stop)):
        n = first = widest = own = 0
        for _, _, start, end, at in splits.walk(t, state, stop):
            if not end:
                assert got == (at, n, first, widest, own, start if n or own else -1)
                break
            own += 1
            if end in "\r\n":
                n, first, widest, own = n + 1, first if n else own, max(widest, own) if n else 0, 0


def test_what_is_known_of_a_grid(spark):
    docs = {1: "a\r\nb,c\r\n", 2: "a\nb", 3: "," * 3000 + "x\n" + "y", 4: "bad\x01,x\n", 5: '"a\r\nb"\nc', 6: ""}
    rows = {r.doc_id: r for r in splits.Grids(pieces(spark, docs, every(2))).grids.collect()}
    got = {d: (r.rows, r.columns, r.left_out, r.eol, r.trailing, r.reason) for d, r in rows.items()}
    assert got == {1: (2, 2, 0, "\r\n", True, None), 2: (2, 1, 0, "\n", False, None), 3: (2, 2048, 953, "\n", False, None), 4: (1, 2, 0, "\n", True, "control characters"), 5: (2, 1, 0, "\r\n", False, None), 6: (0, 0, 0, "\n", False, None)}
    assert splits.Grids(pieces(spark, {1: "a\n" * 11}, every(3)), ";").grids.first().rows == 11


def test_files_in_splits_of_spark(spark, tmp_path):
    rng = random.Random(4)
    field = lambda: rng.choice(["", "plain", '"quoted, with ""marks"" and\r\nbreaks"', "ünïcode", '"' + "long " * 400 + '"'])
    docs = {}
    for i in range(3):
        t = "".join(",".join(field() for _ in range(rng.randint(1, 6))) + rng.choice(["\n", "\r\n"]) for _ in range(1500))
        docs[i] = t + ("tail" if i == 1 else "")
        (tmp_path / f"{i}.csv").write_bytes(docs[i].encode())
    (tmp_path / "3.csv").write_bytes(b"a,\xff\nb,c\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = splits.pieces_of_files(spark, str(tmp_path), 3000)
        assert read.select("doc_id", "seq").distinct().count() > 50 and read.rdd.getNumPartitions() > 10
        grids = splits.Grids(read)
        number = lambda path: int(re.search(r"(\d)\.csv$", path)[1])
        got = sorted((number(r.doc_id), r.row, r.col, r.value, r.quoted) for r in grids.cells().collect())
        assert got == one_pass(docs)[0]
        about = {number(r.doc_id): (r.trailing and not r.reason, r.reason) for r in grids.grids.collect()}
        assert about == {0: (True, None), 1: (False, None), 2: (True, None), 3: (False, "not valid UTF-8")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def mailbox(n, rng, ends="\n"):
    bodies = [f"Subject: {i}\n" + "".join(rng.choice(["\n", "text\n", ">From here\n", "From there\n", "From a Mon Jan  1 10:00:00 2024\n", "Key: v\n", ">>From x\n"]) for _ in range(rng.randint(0, 12))) for i in range(n)]
    return markup.join_mailbox(bodies).replace("\n", ends)


@pytest.mark.parametrize("size", [1, 10, 60, 400, 100_000])
def test_messages_equal_the_one_pass_split_at_any_size(spark, size):
    rng = random.Random(size)
    docs = {1: mailbox(30, rng), 2: mailbox(5, rng, "\r\n"), 3: mailbox(2, rng)[:-1], 4: "not a mailbox\n", 5: "", 6: "\n" + mailbox(2, rng), 7: "preface\n\n" + mailbox(1, rng) + "From b Mon Jan  1 10:00:00 2024", 8: mailbox(20, rng)}
    boxes = splits.Mailboxes(splits.pieces_of_texts(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), size), most=19)
    got = {}
    for r in sorted(boxes.messages().collect()):
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.message == len(got[r.doc_id]) and r.from_line.startswith("From ")
    want = {d: m for d, t in docs.items() if (m := markup.split_mailbox(t, 10**6))}
    refused = {r.doc_id: r.reason for r in boxes.refused.collect()}
    assert refused == {d: "no messages" if d not in want else "over 19 messages" for d in docs if t_has(docs[d]) and (d not in want or len(want[d]) > 19)}
    assert got == {d: m for d, m in want.items() if len(m) <= 19} and len(want[1]) > 19


def t_has(t):
    return t != ""


def test_mailbox_files(spark, tmp_path):
    rng = random.Random(9)
    docs = {i: mailbox(40, rng)[: -1 if i else None] + ("caf\xe9" if i else "") for i in range(2)}
    for i, t in docs.items():
        (tmp_path / f"{i}.mbox").write_bytes(t.encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        boxes = splits.Mailboxes(splits.pieces_of_files(spark, str(tmp_path), 300, "latin-1"))
        got = {}
        for r in boxes.messages().orderBy("doc_id", "message").collect():
            got.setdefault(int(r.doc_id[-6]), []).append(r.text)
        assert got == {i: markup.split_mailbox(t) for i, t in docs.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
