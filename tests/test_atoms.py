import random
import re

from hypothesis import given
from hypothesis import strategies as st

from inkspan.operators import matching as mt
from inkspan.sources import atoms, markup

PAGES = [
    "<p>A &amp; b<br>c <a href='http://x/?id=1'>link</a></p><script>no</script><table><tr><td>1<td>2</tr></table><img alt='pic'>",
    "<h2>T&eacute;st</h2>\n<ul><li>one <li> two</ul><!-- hidden > --><style>x{}</style>&nosuch; &#65;&#x42; a<b>bold</b>c", "plain  text\n\n with   runs ", "<p>open <a href=x", "", "<title>no</title><div><div>x</div></div>&lt;b&gt;",
]


def holds(text, starts, ends, source):
    """Every atom says what the source has at its place."""
    at = 0
    for a in atoms.atoms_of(starts, ends):
        own = text[a["text_start"] : a["text_end"]]
        assert a["text_start"] == at and own
        at = a["text_end"]
        if a["kind"] == "literal":
            assert re.sub(r"[\t\r\n\f]", " ", source[a["start"] : a["end"]]) == own
        elif a["kind"] == "whole":
            assert 0 <= a["start"] < a["end"] <= len(source)
    assert at == len(text)


def test_text_is_what_the_reader_gives_and_atoms_hold():
    for source in PAGES[:3] + PAGES[4:]:
        text, starts, ends, attributes = atoms.html_map(source)
        want, values = markup.html_text(source)
        assert (text, [v for v, *_ in attributes]) == (want, values), source
        holds(text, starts, ends, source)
        assert all(source[a:b] == v for v, a, b in attributes)
    assert atoms.html_map(PAGES[3])[0] == "open"


@given(st.text("ab<>/&;p \n\"='#1xé!-", max_size=60))
def test_any_html(source):
    text, starts, ends, attributes = atoms.html_map(source)
    holds(text, starts, ends, source)


RTF = "{\\rtf1{\\fonttbl Arial;}Caf\\'e9 " + "\\" + "u8364?uro\\par {\\b bo\\i ld}\\{x\\}{\\*\\gen no}" + "\\" + "uc2\\" + "u-10179\\'3f\\'3f\\" + "u-8704\\'3f\\'3f end\\~\\_}"


def test_rtf_text_and_atoms():
    text, starts, ends = atoms.rtf_map(RTF)
    assert text == markup.rtf_text(RTF) == "Café €uro\nbold{x}\U0001f600 end\xa0‑"
    holds(text, starts, ends, RTF)
    euro = next(a for a in atoms.atoms_of(starts, ends) if text[a["text_start"]] == "€")
    assert RTF[euro["start"] : euro["end"]] == "\\" + "u8364?"
    face = next(a for a in atoms.atoms_of(starts, ends) if text[a["text_start"]] == "\U0001f600")
    assert RTF[face["start"] : face["end"]].count("'3f") == 4


@given(st.lists(st.sampled_from(["\\b ", "\\par", "{", "}", "\\'e9", "\\" + "u8364?", "\\" + "u233 ", "text", "é", "\\~", "\\{", "\n", "\\uc0 ", "\\*\\x "]), max_size=25).map("".join))
def test_any_rtf(source):
    text, starts, ends = atoms.rtf_map(source)
    holds(text, starts, ends, source)


def test_nothing_of_the_values_is_left_and_the_rest_stays(spark):
    rng = random.Random(7)
    names = ["Ann Smith", "jörg@x.org", "A&B Ltd", "+34 600 <1>", "Zoé"]
    put = {"Ann Smith": ["Ann Smith", "Ann\n  Smith", "A<b>nn</b> S<i>mi</i>th", "Ann&#32;Smith"], "jörg@x.org": ["jörg@x.org", "j&ouml;rg@x<span>.org</span>", "<a href='mailto:jörg@x.org'>mail</a>"], "A&B Ltd": ["A&amp;B Ltd", "A&B Ltd"], "+34 600 <1>": ["+34 600 &lt;1&gt;"], "Zoé": ["Zo&eacute;", "Zoé"]}
    docs = []
    for d in range(30):
        body = " ".join(rng.choice([f"<p>word {i}</p>", f"keep{i}", *put[rng.choice(names)]]) for i in range(40))
        docs.append((d, f"<html><title>t</title><body>{body}</body></html>"))
    frame = spark.createDataFrame(docs, "doc_id long, html string")
    values = spark.createDataFrame([(d, v, None if v != "Zoé" else "PERSON<1>") for d in range(30) for v in names], "doc_id long, value string, replacement string")
    for r in atoms.redact_html(frame, values).collect():
        text, _, _, attributes = atoms.html_map(r.redacted)
        assert not mt.Matcher([(v, None) for v in names]).find(text) and not any("jörg" in v for v, *_ in attributes)
        assert re.findall(r"keep\d+|word \d+", text) == re.findall(r"keep\d+|word \d+", r.html) and ("[REDACTED]" in text or "PERSON<1>" in text)
        assert re.findall(r"</?(?:p|b|i|span|body|html)>", r.redacted) == re.findall(r"</?(?:p|b|i|span|body|html)>", r.html)


def test_rtf_redaction(spark):
    rtf = "{\\rtf1 Caf\\'e9 {\\b An}n \\" + "u8364?5 Ann}"
    docs = spark.createDataFrame([(1, rtf), (2, "{" * 200), (3, None)], "doc_id long, rtf string")
    values = spark.createDataFrame([(1, "Café"), (1, "ann"), (1, "€5")], "doc_id long, value string")
    got = {r.doc_id: r.redacted for r in atoms.redact_rtf(docs, values, label="{X}").collect()}
    assert got == {1: "{\\rtf1 \\{X\\} {\\b \\{X\\}} \\{X\\} \\{X\\}}", 2: None, 3: None}
    assert markup.rtf_text(got[1]) == "{X} {X} {X} {X}"


def test_pages_and_marks(spark):
    pages = spark.createDataFrame([(1, 1, 0), (1, 2, 10)], "doc_id long, page int, page_start int")
    spans = spark.createDataFrame([(1, 2, 3, 5, None), (1, 1, 0, 1, "S")], "doc_id long, page int, start int, end int, replacement string")
    on = atoms.on_text(spans, pages)
    assert sorted((r.start, r.end) for r in on.collect()) == [(0, 1), (13, 15)]
    source = spark.createDataFrame([(1, "<ul><li>one<li>two three four</ul>")], "doc_id long, html string")
    mapped = source.select("doc_id", atoms.html_atoms("html").alias("h")).select("doc_id", "h.text", "h.atoms")
    assert mapped.first().text == "- one\n- two three four"
    got = atoms.cut_source(source, atoms.source_ranges(on, mapped), "html").first().redacted
    assert got == "<ul><li>one<li>two t[REDACTED]ee four</ul>"  # the first span holds a mark only
