"""Pattern detectors: spans with a category and a confidence, over pages of text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.batches import pieces
from inkspan.functions import checksums, fixed
from inkspan.functions.text import guess_language

SCHEMA = "doc_id long, page int, detector string, category string, confidence double, start int, end int, text string, reason string, everywhere boolean, seq int"
_ORDER = {d[0]: i for i, d in enumerate(fixed.DETECTORS)}
_TOKEN_QUERY = re.compile(r"[?&](token|key|auth|session|id)=|/(share|invite|reset|verify)/", re.I)


@lru_cache(None)
def _pattern(source: str) -> re.Pattern:
    return re.compile(source)


@lru_cache(None)
def _label(kind: str, language: str) -> re.Pattern:
    if language == "en":
        return re.compile(fixed.ENGLISH_LABELS[kind], re.I)
    return re.compile(rf"(?<![^\W\d_])(?:{fixed.LABELS[language][kind]})(?![^\W\d_])[^\n0-9]{{0,30}}\Z", re.I)


def labelled(kind: str, text: str, start: int, languages: Sequence[str]) -> bool:
    """Does a label of this kind, in English or one of the languages, sit just before the place?"""
    if kind in fixed.ENGLISH_LABELS and _label(kind, "en").search(text[max(0, start - 40) : start]):
        return True
    window = text[max(0, start - 64) : start]
    return any(_label(kind, k).search(window) for k in languages if k != "en")


_CHECKS = {
    "phone-number": lambda s: sum("0" <= x <= "9" for x in s) >= 9,
    "us-social-security": checksums.py_ssn,
    "payment-card": checksums.py_luhn,
    "iban": lambda s: not re.search(r"\s", s) or checksums.py_iban(s),
    "es-national-id": checksums.py_dni,
    "fr-social-security": checksums.py_nir,
    "de-tax-id": checksums.py_steuer_id,
    "link-with-token": lambda s: bool(_TOKEN_QUERY.search(s)),
}


_DIGIT = re.compile("[0-9]")
#: What a text must hold for a pattern to match at all; every other detector needs a digit.
_NEEDS = {"email-address": ("@",), "link-with-token": ("://",), "credential": ("_", "-", "AKIA", "AIza")}


_LOCAL = frozenset(c for c in map(chr, range(0x3000)) if re.match(r"(?i:[A-Z0-9._%+-])", c))
_DOMAIN = re.compile(r"(?i:@[A-Z0-9.-]+\.[A-Z]{2,})")


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the address pattern, searched outwards from each @: long unbroken text is passed over once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _places(name: str, source: str, text: str) -> Iterator[tuple[int, int]]:
    return _addresses(text) if name == "email-address" else (m.span() for m in _pattern(source).finditer(text))


def resolve_overlaps(spans: list[tuple]) -> list[tuple]:
    """Greedy: by confidence, length and order of discovery; what overlaps a kept span goes. spans: (start, end,
    confidence, order, ...); the result is ordered by start."""
    kept: list[tuple] = []
    for s in sorted(spans, key=lambda s: (-s[2], s[0] - s[1], s[3])):
        if not any(s[0] < k[1] and k[0] < s[1] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[0])


@lru_cache(None)
def _chosen(names: tuple[str, ...] | None) -> list[tuple]:
    return [d for d in fixed.DETECTORS if names is None or d[0] in names]


def detect_text(text: str, languages: Sequence[str] = ("en",), detectors: Sequence[str] | None = None) -> list[dict]:
    """Detections of one text, without overlaps."""
    keys = ("start", "end", "confidence", "order", "detector", "category", "text", "reason", "everywhere")
    return [dict(zip(keys, s, strict=True)) for s in _detected(text, languages, _chosen(None if detectors is None else tuple(detectors)))]


def _detected(text: str, languages: Sequence[str], chosen: Sequence[tuple]) -> list[tuple]:
    found: list[tuple] = []
    digit = bool(_DIGIT.search(text))
    for name, category, confidence, everywhere, only, label, reason in chosen:
        if only and only not in languages:
            continue
        if not (any(x in text for x in _NEEDS[name]) if name in _NEEDS else digit):
            continue
        sources = [fixed.PATTERNS[name]]
        if name == "street-address":
            sources += [fixed.STREETS[k] for k in languages if k in fixed.STREETS]
        for source in sources:
            for a, end in _places(name, source, text):
                s = text[a:end]
                if not s.strip() or name in _CHECKS and not _CHECKS[name](s) or label and not labelled(label, text, a, languages):
                    continue
                sure = fixed.DOUBTFUL_PHONE if name == "phone-number" and labelled("documentNumber", text, a, languages) else confidence
                found.append((a, end, sure, len(found), name, category, s, reason, everywhere))
    return resolve_overlaps(found) if len(found) > 1 else found


def text_languages(text: Column) -> Column:
    """The language of a whole document's text as an array; all four where it cannot be told."""
    guess = guess_language(text)
    return F.when(guess["detected"], F.array(guess["language"])).otherwise(F.array(*map(F.lit, fixed.LANGUAGES)))


def detect(pages: DataFrame, detectors: Sequence[str] | None = None, languages: str | None = None) -> DataFrame:
    """Detections of pages (doc_id, page, text). languages: a column of language codes (arrays), such as their document's
    ``text_languages``; by default English for every page, and the page's own language, or all four where it cannot be told.
    Languages are not looked at where no detector that is asked for depends on them."""
    names = list(detectors) if detectors is not None else None
    needed = any(only or label or name in ("phone-number", "street-address") for name, _, _, _, only, label, _ in fixed.DETECTORS if names is None or name in names)
    own = F.array(F.lit("en")) if not needed else F.col(languages) if languages else text_languages(F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("detector", pa.string()), ("category", pa.string()), ("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("reason", pa.string()), ("everywhere", pa.bool_()), ("seq", pa.int32())])
        chosen = _chosen(None if names is None else tuple(names))
        for b in pieces(batches, 2):
            rows = []
            for doc, page, text, langs in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for i, (start, end, confidence, _, name, category, s, reason, everywhere) in enumerate(_detected(text, langs, chosen)):
                    rows.append((doc, page, name, category, confidence, start, end, s, reason, everywhere, i))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], schema=kinds)

    return pages.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text", own.alias("languages")).mapInArrow(run, SCHEMA)


def narrow(detections: DataFrame, preset: str) -> DataFrame:
    """Detections that a preset looks for."""
    _, names, categories = next(p for p in fixed.PRESETS if p[0] == preset)
    if names is not None:
        detections = detections.where(F.col("detector").isin(*names.split()))
    return detections if categories is None else detections.where(F.col("category").isin(*categories.split()))


def split_by_confidence(detections: DataFrame, shaky: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(shaky, solid): those at or below the line are worth another look."""
    return detections.where(F.col("confidence") <= shaky), detections.where(F.col("confidence") > shaky)


def merge_verdicts(detections: DataFrame, verdicts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Drop what a verdict (sensitive, new_confidence) calls harmless, take its confidence; without a verdict a row stays."""
    rows = detections.join(verdicts, list(on), "left").where(F.coalesce("sensitive", F.lit(True)))
    return rows.withColumn("confidence", F.coalesce("new_confidence", "confidence")).drop("sensitive", "new_confidence")
