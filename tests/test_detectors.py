import pytest

from inkspan.functions import checksums, fixed
from inkspan.operators import detectors as d
from inkspan.operators import spans as sp

ALL = fixed.LANGUAGES
CASES = [
    ("Write to john.smith+tag@example.co.uk today.", ("en",), "email", "john.smith+tag@example.co.uk"),
    ("Call +1 (415) 555-0132 now", ("en",), "phone", "+1 (415) 555-0132"),
    ("Room 12 at 9am", ("en",), "phone", None),
    ("Ref TXN-0098-4412-7700", ALL, "phone", None),
    ("Invoice number: INV-000842-710395", ALL, "phone", None),
    ("Tel. 040/66969201", ("de",), "phone", "040/66969201"),
    ("+49 (0)40 66969 166", ("de",), "phone", "+49 (0)40 66969 166"),
    ("02 61 91 55 99", ("fr",), "phone", "02 61 91 55 99"),
    ("+33 1 99 00 15 77", ("fr",), "phone", "+33 1 99 00 15 77"),
    ("+34 912 345 678", ("es",), "phone", "+34 912 345 678"),
    ("Card 4111 1111 1111 1111", ("en",), "financial", "4111 1111 1111 1111"),
    ("Order 4111 1111 1111 1112", ("en",), "financial", None),
    ("123-45-6789", ("en",), "government-id", "123-45-6789"),
    ("666-45-6789", ("en",), "government-id", None),
    ("IBAN GB29NWBK60161331926819", ("en",), "bank-account", "GB29NWBK60161331926819"),
    ("Account: 12345678901", ("en",), "bank-account", "12345678901"),
    ("Batch 12345678901 shipped", ("en",), "bank-account", None),
    ("key AKIA" + "A1" * 8, ("en",), "api-key", "AKIA" + "A1" * 8),
    ("DOB: 04/12/1979", ("en",), "date-of-birth", "04/12/1979"),
    ("Invoice dated 04/12/1979", ("en",), "date-of-birth", None),
    ("Customer ID: ACME-88231", ("en",), "customer-id", "ACME-88231"),
    ("Part ACME-88231 in stock", ("en",), "customer-id", None),
    ("https://example.com/reset/abc123", ("en",), "url", "https://example.com/reset/abc123"),
    ("https://example.com/docs/intro", ("en",), "url", None),
    ("Geburtsdatum: 14.02.1978", ("de",), "date-of-birth", "14.02.1978"),
    ("Geburtsdatum: 14.02.1978", ("en",), "date-of-birth", None),
    ("Anschrift: Lindenstraße 27, 10969 Berlin", ("de",), "address", "Lindenstraße 27, 10969 Berlin"),
    ("Kundennummer: KD-4817-29", ("de",), "customer-id", "KD-4817-29"),
    ("Personalausweisnummer V59H7Z2F0", ("de",), "government-id", "V59H7Z2F0"),
    ("Kontonummer: 3608253128", ("de",), "bank-account", "3608253128"),
    ("49 782 584 941", ("de",), "government-id", "49 782 584 941"),
    ("49 782 584 942", ("de",), "government-id", None),
]


@pytest.mark.parametrize("text,languages,category,value", CASES)
def test_accepts_and_rejects(text, languages, category, value):
    hits = [x for x in d.detect_text(text, languages) if x["category"] == category]
    assert [h["text"] for h in hits] == ([value] if value else [])
    assert all(text[h["start"] : h["end"]] == h["text"] for h in hits)


@pytest.mark.parametrize("text,languages", [("Rechnungsnr.: 7000-4129-8841", ("de",)), ("Invoice No.: 0000-4821-9635", ("en",))])
def test_document_numbers_are_doubtful(text, languages):
    assert all(x["confidence"] <= 0.75 for x in d.detect_text(text, languages))


def test_overlaps_keep_the_stronger():
    assert [s[2] for s in d.resolve_overlaps([(0, 10, 0.4, 0), (5, 15, 0.9, 1)])] == [0.9]


def test_column_checks_agree_with_python(spark):
    rows = [("4111 1111 1111 1111",), ("4111111111111112",), ("18",), ("GB29NWBK60161331926819",), ("DE89 3704 0044 0532 0130 00",), ("DE88370400440532013000",), ("12345678Z",), ("X1234567L",), ("X1234567-L",), ("00000000T",), ("1 85 05 78 006 084 36",), ("185057800608491",), ("49 782 584 941",), ("49782584942",), ("123-45-6789",), ("000-45-6789",), ("900-12-3456",), ("123-00-6789",)]
    df = spark.createDataFrame(rows, "s string")
    f = {"luhn": checksums.luhn_valid, "ssn": checksums.ssn_plausible, "iban": checksums.iban_valid, "dni": checksums.dni_valid, "nir": checksums.nir_valid, "tax": checksums.steuer_id_valid}
    got = {r.s: r.asDict() for r in df.select("s", *(g(df.s).alias(k) for k, g in f.items())).collect()}
    for (s,) in rows:
        assert got[s]["luhn"] == checksums.py_luhn(s)
        assert got[s]["iban"] == checksums.py_iban(s)
    assert [s for s in got if got[s]["ssn"]] == ["123-45-6789"]
    assert [s for s in got if got[s]["dni"]] == ["12345678Z", "X1234567L", "X1234567-L", "00000000T"]
    assert [s for s in got if got[s]["tax"]] == ["49 782 584 941"]
    assert all(got[s]["nir"] == checksums.py_nir(s) for s in ("1 85 05 78 006 084 36", "185057800608491"))


def test_pages_and_expansion(spark):
    pages = spark.createDataFrame([(1, 1, "Mail john@example.com and John@Example.com."), (1, 2, "again: john@example.com; xjohn@example.com"), (2, 1, None)], "doc_id long, page int, text string")
    found = d.detect(pages)
    assert found.count() == 4
    places = {(r.page, r.start, r.text) for r in sp.expand_occurrences(found, pages).collect()}
    assert (2, 7, "john@example.com") in places and all(t.lower() in ("john@example.com", "xjohn@example.com") for _, _, t in places)
    assert (2, 26, "john@example.com") not in places
    assert sp.dedupe(found).count() == 4
    values = spark.createDataFrame([("john",), ("john@example.com",), ("absent",)], "value string")
    hits = {(r.page, r.value, r.start) for r in sp.automaton_hits(pages, values).collect()}
    naive = {(p, v, s) for i, p, t in [(r[0], r[1], r[2] or "") for r in pages.collect()] if i == 1 for v in ("john", "john@example.com") for s in range(len(t)) if t.lower().startswith(v, s)}
    assert hits == naive


def test_join_adjacent(spark):
    text = "at 42 Larch Court, Springfield"
    pages = spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")
    rows = [(1, 1, "address", 0.6, 3, 17, text[3:17], ["patterns"]), (1, 1, "address", 0.8, 19, 30, text[19:30], ["model"]), (1, 1, "person", 0.8, 0, 2, "at", ["model"])]
    df = spark.createDataFrame(rows, "doc_id long, page int, category string, confidence double, start int, end int, text string, sources array<string>")
    got = {(r.category, r.text, r.confidence) for r in sp.join_adjacent(df, pages).collect()}
    assert got == {("person", "at", 0.8), ("address", "42 Larch Court, Springfield", 0.8)}


def test_overlap_join_and_cover(spark):
    text = "Call Priya Raman on 555-0142 about INV-2291."
    pages = spark.createDataFrame([(1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 5, 16), (1, 20, 28), (1, 35, 43)], "doc_id long, start int, end int")
    found = spark.createDataFrame([(1, 5, 10), (1, 11, 16), (1, 20, 28), (1, 0, 2)], "doc_id long, start int, end int")
    for width in (4, 512):
        assert sp.overlap_join(labels, found, ["doc_id"], width=width).count() == 3
        assert sp.overlap_join(labels, found, ["doc_id"], "left_anti", width).collect() == [(1, 35, 43)]
    got = {r.start: (r.overlap, r.strict, r.covered) for r in sp.covered_labels(labels, found, pages, ["doc_id"]).collect()}
    assert got == {5: (True, False, True), 20: (True, True, True), 35: (False, False, False)}


def test_touching_is_what_pairs_say(spark):
    rows = lambda n, step: [(i % 3 or None, i * step % 17, i * step % 17 + i % 5) for i in range(n)]
    kind = "doc_id long, start int, end int"
    spans, others = rows(60, 7), rows(40, 5)
    got = sp.touching(spark.createDataFrame(spans, kind), spark.createDataFrame(others, kind), ["doc_id"]).collect()
    assert sorted(map(str, ((r.doc_id, r.start, r.end) for r in got))) == sorted(map(str, spans))
    for r in got:
        own = [(a, b) for d, a, b in others if d == r.doc_id]
        assert r.touched == any(a < r.end and r.start < b for a, b in own)
        assert r.equal == (r.end > r.start and (r.start, r.end) in own)
        assert r.hidden == all(any(a <= p < b for a, b in own) for p in range(r.start, r.end))
