import pytest
from pyspark.sql import functions as F

from inkspan.sources import formats, markup, text


def test_lines_keep_offsets(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\rc\n\nd"), (2, ""), (3, None), (4, "x\n")], "doc_id long, text string")
    got = sorted((r.doc_id, r.line, r.start, r.text) for r in text.split_lines(docs).collect())
    assert got == [(1, 0, 0, "a"), (1, 1, 3, "b"), (1, 2, 5, "c"), (1, 3, 7, ""), (1, 4, 8, "d"), (4, 0, 0, "x")]


def test_pages_are_cut_at_lines(spark):
    t = "".join(f"line {i:04d}\n" for i in range(1000)) + "y" * 5000
    docs = spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")
    rows = sorted(text.paginate(docs).collect())
    own = [r for r in rows if r.doc_id == 1]
    assert "".join(r.text for r in own) == t + "\n" and all(len(r.text) <= 3000 for r in own[:-1])
    assert all(t[r.page_start :].startswith(r.text.rstrip("\n")[:20]) for r in own) and rows[-1].text == ""
    assert text.paginate_text("a\x0bb\r\nc\x85d") == [("a\x0bb\nc\x85d\n", 0)]


def test_delimited_round_trip(spark):
    t = 'name,email\r\n"Smith, J","a ""q"" b"\nx,,z\r"multi\nline",1'
    grid = text.parse_delimited_text(t)
    assert grid[1] == [("Smith, J", True), ('a "q" b', True)] and grid[2] == [("x", False), ("", False), ("z", False)] and len(grid) == 4
    cells = text.delimited_cells(spark.createDataFrame([(1, t)], "doc_id long, text string"))
    lines = [r.line for r in text.write_rows(cells).orderBy("row").collect()]
    assert lines == ["name,email", '"Smith, J","a ""q"" b"', "x,,z", '"multi\nline",1']
    assert text.parse_delimited_text("a,") == [[("a", False), ("", False)]] and text.parse_delimited_text("") == []
    with pytest.raises(ValueError):
        text.parse_delimited_text('"open')


def test_sniffing(spark):
    rows = [(b"%PDF-1.7", "x", "pdf"), (b"\x89PNG\r\n\x1a\n", "x", "image"), (b"RIFF0000WEBP", "x", "image"), (b"PK\x03\x04 word/document.xml", "x", "docx"), (b"PK\x03\x04 other", "x.txt", None), (b"{\\rtf1 x}", "a", "rtf"), (b"From a@b Mon Jan  1 10:00:00 2024\nSubject: x\n\n", "a", "mbox"), (b"Subject: x\r\nFrom: y\r\n\r\nz", "a.txt", "eml"), ("naïve".encode(), "a.CSV", "csv"), (b"\xff\xfe", "a.txt", None), (b"a\x00b", "a.txt", None), (b"plain", "a.bin", None)]
    df = spark.createDataFrame([(bytearray(a), b, c) for a, b, c in rows], "content binary, name string, want string")
    assert df.where(~formats.sniff(F.col("content"), F.col("name")).eqNullSafe(F.col("want"))).collect() == []
    assert formats.registry(spark).count() == 11


def test_html_rtf_and_entities(spark):
    t, attrs = markup.html_text("<head><title>no</title></head><p>A &amp; b<br>c <a href='http://x/?id=1'>link</a></p><script>no</script><table><tr><td>1<td>2</tr></table><img alt='pic'>")
    assert t == "A & b\nc [link](http://x/?id=1)\n\n| 1 | 2 |" and attrs == ["http://x/?id=1", "pic"]
    assert markup.rtf_text("{\\rtf1{\\fonttbl Arial;}Caf\\'e9 " + chr(92) + "u8364?\\par {\\b bold}\\{x\\}{\\*\\gen no}}") == "Café €\nbold{x}"
    df = spark.createDataFrame([("&lt;a&gt; &nosuch; &#233;", "<a> & 'b'")], "e string, d string")
    assert df.select(markup.decode_entities("e"), markup.encode_entities(F.col("d"))).first() == ("<a> &nosuch; é", "&lt;a&gt; &amp; &#39;b&#39;")
    with pytest.raises(ValueError):
        markup.rtf_text("{" * 200)


def test_messages(spark):
    raw = b'From: =?utf-8?q?J=C3=BCrgen?= <j@x.org>\r\nSubject: hi\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain; charset=latin-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\ncaf=E9\r\n--b\r\nContent-Type: text/html\r\n\r\n<b>x</b>\r\n--b\r\nContent-Disposition: attachment; filename="a.pdf"\r\n\r\nx\r\n--b\r\nContent-Type: message/rfc822\r\n\r\nSubject: inner\r\n\r\nbody\r\n--b--\r\n'
    got = spark.createDataFrame([(bytearray(raw),)], "raw binary").select(F.explode(markup.eml_to_sections("raw")).alias("s")).select("s.*").collect()
    assert got[0].text.startswith("From: Jürgen <j@x.org>\nSubject: hi") and [g.kind for g in got] == ["headers", "text", "html", "headers", "text", "attachments"]
    assert got[1].text.strip() == "café" and got[2].text == "x" and got[3].depth == 1 and got[5].text == "a.pdf"


def test_mailboxes(spark):
    messages = ["Subject: a\n\nhello\n>From here\n", "Subject: b\n\nFrom there\n\nFrom a line\nno header\n"]
    assert markup.split_mailbox(markup.join_mailbox(messages)) == messages
    boxes = spark.createDataFrame([(1, markup.join_mailbox(messages)), (2, "no mailbox")], "parent_id long, text string")
    known = spark.createDataFrame([(1, "msg-1")], "parent_id long, part_path string")
    assert [(r.parent_id, r.part_path) for r in markup.expand_mailboxes(boxes, known).collect()] == [(1, "msg-2")]
    plan = markup.attachment_plan(spark.createDataFrame([(1, 1, None, None, 5, 0), (1, 2, "pdf", "pdf", 30 << 20, 0), (1, 3, "pdf", "txt", 5, 0), (1, 4, "pdf", None, 20 << 20, 0), (1, 5, "pdf", None, 20 << 20, 3), (1, 6, "pdf", None, 24 << 20, 0), (1, 7, "pdf", None, 24 << 20, 0)], "parent_id long, seq int, kind string, claimed_kind string, size long, depth int"))
    assert [r.decision for r in plan.orderBy("seq").collect()] == ["carry", "too-large", "extension-mismatch", "expand", "too-deep", "expand", "too-large-together"]


def test_recognised_words(spark):
    words = spark.createDataFrame([(1, 1, 0, " ab ", 0.9, 1.0, 2.0, 3.0, 4.0), (1, 1, 1, "no", 0.1, 1.0, 2.0, 3.0, 4.0), (1, 1, 2, "c", 0.9, 1.0, 2.0, 3.0, 4.0)], "doc_id long, page int, seq int, text string, confidence double, x double, y double, width double, height double")
    assert [(r.text, r.start, r.end, r.x) for r in text.ocr_spans(words, scale=2.0).orderBy("seq").collect()] == [("ab", 0, 2, 2.0), ("c", 3, 4, 2.0)]


def test_one_bad_document_leaves_the_others(spark):
    docs = spark.createDataFrame([(1, "a,b\n"), (2, 'x,"open'), (3, "," * 2048 + "x"), (4, None), (5, 'c,""')], "doc_id long, text string")
    cells, refused = text.read_grids(docs)
    assert sorted((r.doc_id, r.row, r.col, r.value) for r in cells.collect()) == [(1, 1, 1, "a"), (1, 1, 2, "b"), (5, 1, 1, "c")]
    assert {r.doc_id: r.reason for r in refused.collect()} == {2: "a quoted field is never closed", 3: "over 2048 columns"}
    pages, refused = text.read_pages(docs.withColumn("text", F.when(F.col("doc_id") == 1, F.repeat(F.lit("y"), text.MAX_CHARS + 1)).otherwise(F.col("text"))))
    assert {r.doc_id for r in pages.collect()} == {2, 3, 4, 5} and refused.collect() == [(1, f"over {text.MAX_CHARS} characters")]
    deep = "{" * (markup.RTF_DEPTH + 1) + "x"
    got = spark.createDataFrame([(1, deep), (2, "{ok}"), (3, None)], "i int, s string").select("i", markup.rtf_outcome("s").alias("o")).select("i", "o.*").collect()
    assert {r.i: (r.text, bool(r.reason)) for r in got} == {1: (None, True), 2: ("ok", False), 3: (None, False)}
    nest = b"".join(b"Content-Type: message/rfc822\n\n" for _ in range(markup.MAX_NESTED + 2)) + b"Subject: in\n\nx"
    got = spark.createDataFrame([(1, bytearray(nest)), (2, bytearray(b"Subject: s\n\nbody"))], "i int, raw binary").select("i", markup.eml_outcome("raw").alias("o")).select("i", "o.*").collect()
    assert {r.i: (r.sections is not None, r.reason) for r in got} == {1: (False, "messages are nested too deeply"), 2: (True, None)}
    many = markup.join_mailbox(["Subject: a\n\nb\n"] * (markup.MAX_MESSAGES + 1))
    boxes = spark.createDataFrame([(1, many), (2, markup.join_mailbox(["Subject: a\n\nb\n"]))], "parent_id long, text string")
    known = spark.createDataFrame([], "parent_id long, part_path string")
    assert [(r.parent_id, r.part_path) for r in markup.expand_mailboxes(boxes, known).collect()] == [(2, "msg-1")]
    assert [(r.parent_id, r.reason) for r in markup.refused_mailboxes(boxes).collect()] == [(1, f"over {markup.MAX_MESSAGES} messages")]


def test_pages_take_their_documents_language(spark):
    from inkspan.operators import detectors

    german = "Der Mann und die Frau sind nicht mit dem Hund auf der Straße, und das ist für die Kinder ein Problem.\n" * 40
    docs = spark.createDataFrame([(1, german + "12 345\n"), (2, None)], "doc_id long, text string").withColumn("languages", detectors.text_languages(F.col("text")))
    pages = text.paginate(docs, most=400, keep="languages").collect()
    assert {tuple(r.languages) for r in pages if r.doc_id == 1} == {("de",)} and sum(r.doc_id == 1 for r in pages) > 5
    assert [(r.page, len(r.languages)) for r in pages if r.doc_id == 2] == [(1, 4)]
