"""String kernel: folding, bands, counts and context as column expressions. Offsets are code points, 0-based, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def normalize_value(c: Column) -> Column:
    """Trimmed, lower-case, runs of white space as one space: what decides that two values are the same."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), f"\\A{SPACE}+|{SPACE}+\\z", ""), f"{SPACE}+", " ")


def ws_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"\\A{SPACE}+|{SPACE}+\\z", "")


def confidence_band(c: Column) -> Column:
    return F.when(c.isNull(), "medium").when(c >= 0.85, "high").when(c >= 0.6, "medium").otherwise("low")


def known_category(c: Column) -> Column:
    return F.when(c.isin(*fixed.CATEGORIES), c).otherwise("other")


def occurrences(text: Column, needle: Column) -> Column:
    """Matches that do not overlap, whatever the case."""
    low, n = F.lower(text), F.lower(needle)
    return F.when(F.length(needle) > 0, ((F.length(low) - F.length(F.replace(low, n, F.lit("")))) / F.length(n)).cast("long")).otherwise(0)


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def sample_around(text: Column, start: Column, end: Column, reach: int = 40) -> Column:
    """before, match and after of a hit, white space folded, with an ellipsis where text was cut."""
    before = F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, start - F.greatest(start - reach, F.lit(0)))
    after = F.substring(text, end + 1, F.least(F.length(text) - end, F.lit(reach)))
    return F.struct(
        F.concat(F.when(start > reach, "…").otherwise(""), F.ltrim(F.regexp_replace(before, r"\s+", " "))).alias("before"),
        F.substring(text, start + 1, end - start).alias("match"),
        F.concat(F.rtrim(F.regexp_replace(after, r"\s+", " ")), F.when(end + reach < F.length(text), "…").otherwise("")).alias("after"),
    )


def stands_alone(text: Column, start: Column, end: Column) -> Column:
    """Not part of a longer token: no letter or digit before, no digit after, no joiner with more on its other side."""
    before = F.substring(text, F.greatest(start - 1, F.lit(1)), F.least(start, F.lit(2)))
    after = F.substring(text, end + 1, F.lit(2))
    return ~before.rlike(r"[\p{L}\p{N}]\z|[\p{L}\p{N}][.@_+-]\z") & ~after.rlike(r"\A\p{N}|\A[.@_+-][\p{L}\p{N}]")


def guess_language(text: Column, sample: int = 20_000, least: int = 5, margin: int = 2) -> Column:
    """struct(language, detected): by counts of function words in the first characters, English when it is not clear."""
    words = F.regexp_extract_all(F.lower(F.substring(text, 1, sample)), F.lit(r"(\p{L}+)"), F.lit(1))

    def hits(markers: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*markers.split())))

    counts = F.array(*(F.struct(hits(m).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, m) in enumerate(fixed.MARKERS.items())))
    ranked = F.sort_array(counts, asc=False)
    best, second = ranked[0], ranked[1]
    sure = (best["n"] >= least) & (best["n"] >= second["n"] * margin)
    return F.struct(F.when(sure, best["k"]).otherwise("en").alias("language"), F.coalesce(sure, F.lit(False)).alias("detected"))


def describe_language(language: Column, detected: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in fixed.LANGUAGE_NAMES.items() for x in kv))
    return F.when(~detected, "language not recognised, read as English").when(language != "en", F.concat(F.lit("read as "), names[language]))


def quote_field(c: Column, delimiter: str = ",", quoted: Column | None = None) -> Column:
    """A delimited field as written: quoted where it was, or where it must be."""
    need = c.rlike(f'["\\r\\n{delimiter}]')
    need = need if quoted is None else need | quoted
    return F.when(need, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def byte_size(c: Column) -> Column:
    """'10 MiB', '4kb', '17' as bytes; null if it is none."""
    n = F.regexp_extract(c, r"(?i)\A\s*([0-9]+(?:\.[0-9]+)?)\s*(?:[kmgt]i?b?|b)?\s*\z", 1)
    unit = F.lower(F.regexp_extract(c, r"(?i)([kmgt])i?b?\s*\z", 1))
    power = F.create_map(*(F.lit(x) for kv in {"": 0, "k": 1, "m": 2, "g": 3, "t": 4}.items() for x in kv))[unit]
    return F.when(n != "", F.floor(n.cast("double") * F.pow(F.lit(1024.0), power)).cast("long"))
