"""What a reviewer asks: what is uncovered, what covers a value, which word is under the cursor, which table columns hold
references, how long a document stays."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkspan.functions import fixed
from inkspan.functions.text import normalize_value

from .ranks import percentiles
from .rules import MAX_LENGTH, PatternError, compile_pattern
from .spans import expand_occurrences, overlap_join

PLACE = ["doc_id", "page"]


def find_uncovered(detections: DataFrame, redactions: DataFrame) -> DataFrame:
    """doc_id, category, normalized, value, hits: detections that no redaction touches, by folded value."""
    left = overlap_join(detections, redactions.select(*PLACE, "start", "end"), PLACE, "left_anti")
    rows = left.withColumn("normalized", normalize_value(F.col("text")))
    return rows.groupBy("doc_id", "category", "normalized").agg(F.min_by("text", F.struct("page", "start")).alias("value"), F.count("*").alias("hits"))


def occurrence_states(values: DataFrame, pages: DataFrame, redactions: DataFrame) -> DataFrame:
    """doc_id, page, start, end, text, state: every place of values (doc_id, value) with the status of the redaction over it,
    ``uncovered`` where there is none; accepted wins over suggested over rejected."""
    asked = values.select("doc_id", F.col("value").alias("text"), F.lit("other").alias("category"), F.lit("").alias("reason"), F.lit(True).alias("everywhere"), F.lit(0).alias("seq"))
    hits = expand_occurrences(asked, pages, standalone=False).select(*PLACE, "start", "end", "text")
    over = overlap_join(hits, redactions.select(*PLACE, "start", "end", "status"), PLACE)
    rank = F.when(F.col("r_status") == "accepted", 0).when(F.col("r_status") == "suggested", 1).otherwise(2)
    best = over.groupBy(*PLACE, "start", "end").agg(F.min_by("r_status", rank).alias("state"))
    return hits.join(best, [*PLACE, "start", "end"], "left").fillna("uncovered", ["state"])


def expiring(documents: DataFrame, now: Column) -> DataFrame:
    return documents.where(F.col("expires") <= now)


def extend_retention(created: Column, expires: Column, seconds: Column, now: Column, allowed: Sequence[int], most: int = 72 * 3600) -> Column:
    """struct(reason, expires): what becomes of a request to keep a document for so many seconds from its creation."""
    at = F.timestamp_seconds(F.unix_timestamp(created) + F.least(seconds, F.lit(most)))
    ceiling = F.timestamp_seconds(F.unix_timestamp(created) + most)
    reason = F.when(~seconds.isin(*allowed), "unsupported-window").when(expires >= ceiling, "already-at-limit").when(at <= expires, "not-an-extension").when(at <= now, "would-expire-immediately")
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), at).alias("expires"))


# What a token is made of, what it does not begin or end with, a group of a value written in groups, and the
# longest such value.
TOKEN = r"[\p{L}\p{N}\p{M}_@+\-'.]"
EDGE = "@+-'."
GROUP = r"(?:[A-Z0-9]{1,4}|[0-9.-]*[0-9][0-9.-]*)"
MAX_RUN, WINDOW = 42, 256

_TOKENS, _OUTSIDE, _GROUP = regex.compile(TOKEN + "+"), regex.compile(f"(?r)[^{TOKEN[1:]}"), re.compile(GROUP + r"\Z")


def _tokens(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """The tokens, without joiners at their edges, that lie in or cross a window of the text."""
    before = _OUTSIDE.search(text, 0, low)
    out = []
    for m in _TOKENS.finditer(text, before.end() if before else 0):
        if m.start() > high:
            break
        body = m[0].strip(EDGE)
        if body:
            a = m.start() + len(m[0]) - len(m[0].lstrip(EDGE))
            out.append((a, a + len(body)))
    return out


def word_at(text: str, offset: int) -> tuple[int, int] | None:
    """The token under an offset (or before it, at a token's end), widened to the number written in groups that it is part
    of, and to what a detector finds there; None where there is none."""
    from .detectors import detect_text

    if not 0 <= offset <= len(text):
        return None
    at = next((i for i in (offset, offset - 1) if 0 <= i < len(text) and _TOKENS.match(text[i])), None)
    if at is None:
        return None
    every = _tokens(text, max(0, at - WINDOW), at + WINDOW)
    one = regex.search(f"(?r){TOKEN}*", text, pos=0, endpos=at).start(), _TOKENS.match(text, at).end()
    i = next((i for i, (a, b) in enumerate(every) if one[0] <= a and b <= one[1]), None)
    if i is None:
        return None
    a, b = every[i]
    part = lambda j: text[slice(*every[j])]
    if _GROUP.match(part(i)):
        lo = hi = i
        while lo and text[every[lo - 1][1] : every[lo][0]] == " " and _GROUP.match(part(lo - 1)):
            lo -= 1
        while hi + 1 < len(every) and text[every[hi][1] : every[hi + 1][0]] == " " and _GROUP.match(part(hi + 1)):
            hi += 1
        number = [j for j in range(lo, hi + 1) if re.search("[0-9]", part(j))]
        if len(number) > 1 and number[0] <= i <= number[-1] and every[number[-1]][1] - every[number[0]][0] <= MAX_RUN:
            a, b = every[number[0]][0], every[number[-1]][1]
    start = max(0, at - WINDOW)
    for d in detect_text(text[start : at + WINDOW], fixed.LANGUAGES):
        if d["start"] + start <= at < d["end"] + start:
            a, b = min(a, d["start"] + start), max(b, d["end"] + start)
            break
    return a, b


# Words for a person in a header, and words for a reference.
PERSON = r"customer|client|member|patient|employee|staff|policy\s*holder|account\s*holder|subscriber|tenant|kunden?|mitglieds?|patienten|personal|versicherten|adh[ée]rent|membre|salari[ée]|cliente|socio|paciente|empleado|asegurado"
REFERENCE = r"(?<![^\W\d_])(?:ref|reference|referenz|referencia|r[ée]f[ée]rence|id|no|num|number|n[°º]|n[uú]mero|num[ée]ro|code|#)(?![^\W\d_])|(?:nummer|nr)(?![^\W\d_])"


def is_person_reference(header: str) -> bool:
    return len(header) <= 40 and bool(re.search(PERSON, header, re.I)) and bool(re.search(REFERENCE, header, re.I))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("header", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())])))
def reference_cells(text: pd.Series) -> pd.Series:
    """Filled cells of table columns in a text whose header names a person's reference. A cell in quotes may hold the
    separator; its bounds are those within the quotes, and a doubled quote is one."""
    quoted = {sep: re.compile(rf'[ ]*"((?:[^"]|"")*)"[ ]*(?={re.escape(sep)}|\Z)|([^{re.escape(sep)}]*)') for sep in "\t|;,"}

    def cells(line: str, at: int, sep: str) -> list[tuple[str, int, int]]:
        out, i = [], 0
        while i <= len(line):
            m = quoted[sep].match(line, i)
            k = 1 if m[1] is not None else 2
            a, value = at + m.start(k), m[k]
            if k == 2:
                a, value = a + len(value) - len(value.lstrip()), value.strip()
            out.append((value.replace('""', '"') if k == 1 else value, a, a + len(value)))
            i = m.end() + len(sep)
        return out

    def find(t: str) -> list[dict]:
        out = []
        for sep in ("\t", "|", ";", ","):
            at, block = 0, []
            for line in [*t.split("\n"), None]:
                row = cells(line, at, sep) if line is not None else []
                if block and len(row) != len(block[0]):
                    for k, head in enumerate(block[0]):
                        if len(block) > 1 and is_person_reference(head[0]):
                            out += [{"header": head[0], "start": r[k][1], "end": r[k][2], "value": r[k][0]} for r in block[1:] if re.search(r"\w", r[k][0]) and not re.fullmatch(r"(?i)n/?a|none|null", r[k][0])]
                    block = []
                if len(row) >= 3:
                    block.append(row)
                at += len(line or "") + 1
        return out

    return text.fillna("").map(find)


def unlabelled_cells(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, page, start, end, header, text of reference cells that no label touches."""
    found = pages.select(*PLACE, F.explode(reference_cells("text")).alias("c")).select(*PLACE, "c.start", "c.end", "c.header", F.col("c.value").alias("text"))
    return overlap_join(found, labels.select(*PLACE, "start", "end"), PLACE, "left_anti")


def with_sources(*passes: tuple[str, DataFrame]) -> DataFrame:
    """doc_id, page, start, end, category, source: one row a place; of several passes the last one names it."""
    keys = [*PLACE, "start", "end", "category"]
    rows = reduce(DataFrame.unionByName, (df.select(*keys, F.lit(i).alias("_i"), F.lit(s).alias("source")) for i, (s, df) in enumerate(passes)))
    return rows.groupBy(*keys).agg(F.max_by("source", "_i").alias("source"))


def expansion_by_repeat(entities: DataFrame) -> DataFrame:
    """bucket, values, hits: how often values repeat (1, 2-4, 5-9, 10+)."""
    n = F.col("occurrences")
    b = F.when(n == 1, "1").when(n < 5, "2-4").when(n < 10, "5-9").otherwise("10+")
    return entities.groupBy(b.alias("bucket")).agg(F.count("*").alias("values"), F.sum(n).alias("hits"))


def throughput(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, documents, calls, documents a minute, tokens a minute, p95 (nearest rank) from calls (doc_id, at, ms, tokens)."""
    k = list(keys)
    minutes = F.greatest((F.max(F.unix_millis(F.col("at").cast("timestamp"))) - F.min(F.unix_millis(F.col("at").cast("timestamp")))) / 60000.0, F.lit(1 / 60.0))
    counts = calls.groupBy(*k).agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("calls"), F.round(F.count_distinct("doc_id") / minutes, 4).alias("documents_per_minute"), F.round(F.sum("tokens") / minutes, 4).alias("tokens_per_minute"))
    ranks = percentiles(calls, k, "ms", [0.95]).select(*(F.col(c).alias(f"_{c}") for c in k), F.col("p95").alias("p95_ms"))
    return counts.join(ranks, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in k], "left").drop(*(f"_{c}" for c in k))


# Words that a preset's name may not hold.
FORBIDDEN = [
    "gdpr", "hipaa", "ccpa", "cpra", "pci", "dss", "sox", "ferpa", "glba", "soc 2", "soc2", "iso 27001", "nist", "compliant", "compliance",
    "certified", "certification", "regulation", "regulatory", "lawful", "legally", "safe harbor", "safe harbour", "anonymized", "anonymised", "guarantee",
]


def preset_problems(presets: DataFrame) -> DataFrame:
    """id, word: presets whose id, label, summary or looks_for (if there) claims what a search cannot achieve."""
    words = F.array(*map(F.lit, FORBIDDEN))
    said = F.lower(F.concat_ws(" ", *(c for c in ("id", "label", "summary", "looks_for") if c in presets.columns)))
    return presets.select("id", F.explode(words).alias("word"), said.alias("_s")).where(F.contains("_s", "word")).select("id", "word")


#: Rules that an owner has at most, and a file.
RULE_CAP = 200


class RuleFileError(ValueError):
    pass


@F.pandas_udf(T.StringType())
def pattern_problem(pattern: pd.Series, kind: pd.Series, match_case: pd.Series, whole_word: pd.Series) -> pd.Series:
    """Why a pattern does not compile; null if it does."""

    def problem(*spec) -> str | None:
        try:
            compile_pattern(*spec)
        except PatternError as e:
            return str(e)

    return pd.Series([problem(p, k, bool(m), bool(w)) for p, k, m, w in zip(pattern, kind, match_case, whole_word, strict=True)], dtype=object)


def sorted_entries(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """entries (seq, pattern, kind, match_case, whole_word, category, enabled) with outcome: invalid (problem says why),
    duplicate (of an existing rule or an earlier entry: the same kind, pattern, options and category) or new."""
    key = ["kind", "pattern", "match_case", "whole_word", "category"]
    rows = entries.withColumn("problem", pattern_problem("pattern", "kind", "match_case", "whole_word"))
    known = existing.select(*(F.coalesce(k, F.lit(False)).alias(k) if k in ("match_case", "whole_word") else k for k in key)).distinct().withColumn("_known", F.lit(True))
    first = F.min(F.when(F.col("problem").isNull(), F.col("seq"))).over(Window.partitionBy(*key))
    rows = rows.withColumn("_first", first).join(F.broadcast(known), key, "left")
    outcome = F.when(F.col("problem").isNotNull(), "invalid").when(F.col("_known") | (F.col("_first") < F.col("seq")), "duplicate").otherwise("new")
    return rows.select("seq", *key, "enabled", "problem", outcome.alias("outcome"))


def read_rule_file(spark, path: str) -> DataFrame:
    """Entries of a versioned JSON file. RuleFileError where it is of another version, has more rules than an owner may, or an
    entry without kind, pattern or category, or one that is too long."""
    rule = "array<struct<pattern:string,kind:string,match_case:boolean,whole_word:boolean,category:string,enabled:boolean>>"
    file = spark.read.schema(f"version int, rules {rule}").option("multiLine", True).json(path)
    said = file.select("version", F.size("rules").alias("n")).collect()  # a row a file
    if len(said) != 1 or said[0].version != 1 or said[0].n is None or not 0 <= said[0].n <= RULE_CAP:
        raise RuleFileError("not a file of rules")
    rows = file.select(F.posexplode("rules").alias("seq", "r")).select("seq", "r.*")
    bad = ~F.coalesce(F.col("kind").isin("literal", "regex") & F.length("pattern").between(1, MAX_LENGTH) & F.length("category").between(1, 60), F.lit(False))
    if not rows.where(bad).isEmpty():
        raise RuleFileError("an entry is not a rule")
    fills = {"match_case": False, "whole_word": False, "enabled": True}
    return rows.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in fills.items()})


def import_rules(spark, path: str, existing: DataFrame, cap: int = RULE_CAP) -> DataFrame:
    """The new rules of a file. All of them or none: RuleFileError where they and the existing ones are over the cap.
    ``sorted_entries`` of ``read_rule_file`` also says what is a duplicate and what is invalid, and why."""
    rows = sorted_entries(read_rule_file(spark, path), existing).where("outcome = 'new'")
    if (n := existing.count() + rows.count()) > cap:
        raise RuleFileError(f"{n} rules, {cap} at most")
    return rows.drop("outcome", "problem").orderBy("seq")


def export_rules(rules: DataFrame) -> DataFrame:
    """One row: the rules as the JSON that import_rules reads; over 200 are refused."""
    enabled = F.coalesce(F.col("enabled"), F.lit(True)) if "enabled" in rules.columns else F.lit(True)
    r = F.struct("pattern", "kind", "match_case", "whole_word", "category", enabled.alias("enabled"))
    if rules.limit(201).count() > 200:
        raise ValueError("over 200 rules")
    return rules.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.sort_array(F.collect_list(r)).alias("rules"))).alias("value"))


def text_boxes(spans: DataFrame, words: DataFrame, pad: float = 1.5) -> DataFrame:
    """spans with a box: the union of the boxes of the words (doc_id, page, start, end, x, y, width, height) that they
    touch, a word's box cut in proportion to the characters covered, padded."""
    both = overlap_join(spans, words, PLACE)
    share = lambda at: (at - F.col("r_start")) / (F.col("r_end") - F.col("r_start")) * F.col("r_width")
    left = F.col("r_x") + share(F.greatest("start", "r_start"))
    right = F.col("r_x") + share(F.least("end", "r_end"))
    return both.groupBy(*PLACE, "start", "end", F.col("r_y").alias("line")).agg((F.min(left) - pad).alias("x"), (F.min("r_y") - pad).alias("y"), (F.max(right) - F.min(left) + 2 * pad).alias("width"), (F.max("r_height") + 2 * pad).alias("height")).drop("line")
