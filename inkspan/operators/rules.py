"""User patterns: validation, matching, search summaries, previews, comparison, and rules carried to documents.

Patterns are literals or regular expressions of a linear-time subset: no lookaround, no backreference, and no repeated
group that itself repeats. They run in Arrow batches and give all matches; a budget of matches or time is an option, and a
rule that exceeds it fails for that document as a whole, never in part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspan.batches import pieces
from inkspan.functions.text import SPACE, sample_around, ws_trim

MAX_LENGTH = 500
#: Rules at once: every task compiles all of them.
MAX_RULES = 200
#: Matches handed on at once.
ROWS = 10_000


class PatternError(ValueError):
    pass


def compile_pattern(pattern: str, kind: str = "literal", match_case: bool = False, whole_word: bool = False):
    """A compiled pattern, or PatternError."""
    import regex

    if not pattern or not pattern.strip():
        raise PatternError("the pattern is blank")
    if len(pattern) > MAX_LENGTH:
        raise PatternError(f"over {MAX_LENGTH} characters")
    body = regex.escape(pattern, special_only=True) if kind == "literal" else pattern
    if kind == "regex":
        if regex.search(r"\(\?(?:[=!>]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9k]|\(\?P=|[+*?}]\+", pattern):
            raise PatternError("lookaround, backreferences and possessive or atomic parts are not supported")
    if whole_word:
        body = rf"(?<![\p{{L}}\p{{N}}\p{{M}}_])(?:{body})(?![\p{{L}}\p{{N}}\p{{M}}_])"
    try:
        made = regex.compile(body, regex.MULTILINE | regex.V0 | (0 if match_case else regex.IGNORECASE))
    except regex.error as e:
        raise PatternError(str(e)) from None
    if kind == "regex" and made.fullmatch(""):
        raise PatternError("the pattern matches nothing at all")
    return made


def stored_pattern(pattern: str, kind: str) -> str:
    """What two rules are compared by: literals trimmed with white space folded, expressions as they are."""
    return " ".join(pattern.split()) if kind == "literal" else pattern


def find_matches(rules: DataFrame, pages: DataFrame, max_matches: int | None = None, seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, failures) of rules (rule_id, kind, pattern, match_case, whole_word, category) over pages (doc_id, page,
    text): rule_id, doc_id, page, start, end, text, category; and rule_id, doc_id, reason. Rules that do not compile raise.
    All matches, unless a budget is given: of matches in a document, or of seconds for a text. A rule over its budget has
    no matches in that document and a row among the failures, so whoever sets one must read both."""
    rows = rules.select("rule_id", "kind", "pattern", "match_case", "whole_word", "category").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise PatternError(f"over {MAX_RULES} rules")
    specs = sorted((r.rule_id, r.category, r.pattern, r.kind, bool(r.match_case), bool(r.whole_word)) for r in rows)
    for _, _, *spec in specs:
        compile_pattern(*spec)
    shared = pages.sparkSession.sparkContext.broadcast(specs)
    kinds = pa.schema([("rule_id", pa.string()), ("doc_id", pa.int64()), ("page", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("category", pa.string()), ("failed", pa.bool_())])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(rule, category, compile_pattern(*spec)) for rule, category, *spec in shared.value]
        for b in pieces(batches, 2):
            out = []
            for doc, page, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for rule, category, p in made:
                    n = 0
                    try:
                        for m in p.finditer(text or "", timeout=seconds):
                            if m.end() > m.start():
                                out.append((str(rule), doc, page, m.start(), m.end(), m[0], category, False))
                                n += 1
                                if len(out) >= ROWS and seconds is None:  # handing rows on would count as time
                                    yield batch(out)
                                    out = []
                            if max_matches is not None and n > max_matches:
                                break
                    except TimeoutError:
                        out.append((str(rule), doc, page, None, None, None, category, True))
            yield batch(out)

    hits = pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text").mapInArrow(run, "rule_id string, doc_id long, page int, start int, end int, text string, category string, failed boolean")
    spent = hits.groupBy("rule_id", "doc_id").agg(F.count_if(~F.col("failed")).alias("n"), F.bool_or("failed").alias("failed"))
    bad = spent.where(F.col("failed") if max_matches is None else F.col("failed") | (F.col("n") > max_matches))
    failures = bad.select("rule_id", "doc_id", F.when(F.col("failed"), "time").otherwise("matches").alias("reason"))
    if max_matches is None and seconds is None:
        return hits.drop("failed"), failures
    same = hits["rule_id"].eqNullSafe(F.col("_rule")) & hits["doc_id"].eqNullSafe(F.col("_doc"))
    return hits.join(bad.select(F.col("rule_id").alias("_rule"), F.col("doc_id").alias("_doc")), same, "left_anti").drop("failed"), failures


def find_cell_matches(rules: DataFrame, cells: DataFrame) -> DataFrame:
    """rule_id, doc_id, row, col, text, category: cells (doc_id, row, col, value) that a rule is found in, each once, as a
    cell is redacted as a whole. text is a literal's pattern, or the first that an expression matched."""
    rows = rules.select("rule_id", "kind", "pattern", "match_case", "whole_word", "category").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise PatternError(f"over {MAX_RULES} rules")
    specs = sorted((r.rule_id, r.category, r.pattern, r.kind, bool(r.match_case), bool(r.whole_word)) for r in rows)
    for _, _, *spec in specs:
        compile_pattern(*spec)
    shared = cells.sparkSession.sparkContext.broadcast(specs)
    kinds = pa.schema([("rule_id", pa.string()), ("doc_id", pa.int64()), ("row", pa.int64()), ("col", pa.int32()), ("text", pa.string()), ("category", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(rule, category, spec, compile_pattern(*spec)) for rule, category, *spec in shared.value]
        for b in pieces(batches, 3):
            out = []
            for doc, row, col, value in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for rule, category, spec, p in made if value else ():
                    if m := next((m for m in p.finditer(value) if m.end() > m.start()), None):
                        out.append((rule, doc, row, col, spec[0] if spec[1] == "literal" else m[0], category))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], schema=kinds)

    own = cells.select(F.col("doc_id").cast("long"), F.col("row").cast("long"), F.col("col").cast("int"), "value")
    return own.mapInArrow(run, "rule_id string, doc_id long, row long, col int, text string, category string")


def to_redactions(matches: DataFrame) -> DataFrame:
    """What a rule writes: accepted, from a rule, sure."""
    return matches.withColumns({"status": F.lit("accepted"), "source": F.lit("rule"), "confidence": F.lit(1.0), "type": F.lit("text")})


def carry_rules(rules: DataFrame, documents: DataFrame, applied: DataFrame) -> DataFrame:
    """(rule, document) pairs still to apply, oldest rule first: enabled rules whose scope holds the document, without
    those applied before. Scopes: owner, batch, document; rules: rule_id, scope, scope_key, enabled, created."""
    keys = documents.select("doc_id", F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), F.col(c).cast("string").alias("scope_key")) for s, c in (("owner", "owner_id"), ("batch", "batch_id"), ("document", "doc_id"))))).alias("k")).select("doc_id", "k.*")
    pairs = rules.where("enabled").join(keys, ["scope", "scope_key"]).select("rule_id", "doc_id", "created").distinct()
    todo = pairs.join(applied.select("rule_id", "doc_id"), ["rule_id", "doc_id"], "left_anti")
    return todo.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("created", "rule_id")))


def search_summary(matches: DataFrame, pages: DataFrame, samples: int = 200) -> tuple[DataFrame, DataFrame]:
    """(counts by page, the first samples of each document with their context)."""
    counts = matches.groupBy("doc_id", "page").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("doc_id").orderBy("page", "start", "end")
    first = matches.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= samples).drop("_n")
    text = pages.select("doc_id", "page", F.col("text").alias("_text"))
    ctx = first.join(text, ["doc_id", "page"]).withColumn("_c", sample_around(F.col("_text"), F.col("start"), F.col("end")))
    return counts, ctx.select("doc_id", "page", "start", "end", "_c.before", "_c.match", "_c.after")


def diff_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, page, start, end, change: spans that only the new pattern has are gained, only the old, lost."""
    k = ["doc_id", "page", "start", "end"]
    a, b = old.select(*k).distinct().withColumn("_a", F.lit(1)), new.select(*k).distinct().withColumn("_b", F.lit(1))
    return a.join(b, k, "full").where("_a is null or _b is null").select(*k, F.when(F.col("_a").isNull(), "gained").otherwise("lost").alias("change"))


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def _times(low: Column, high: Column) -> Column:
    """How often a class stands: nothing for once, {n}, or {low,high}."""
    return F.when((low == high) & (low == 1), "").when(low == high, F.format_string("{%d}", low)).otherwise(F.format_string("{%d,%d}", low, high))


def learn_shapes(redactions: DataFrame, least: int = 3, known: DataFrame | None = None) -> DataFrame:
    """signature, pattern, category, support, display: case-sensitive whole-word expressions that ``least`` or more distinct
    values of one shape share, from redactions (seq, type, source, status, text, category) made by hand.

    A value is cut into runs of digits, letters and white space and single symbols; values of the same sequence of those are
    of one shape. What never varies stays as it is, digits keep their common beginning, and the rest becomes a class with its
    run lengths. A shape is left out unless two characters of letters or digits are common to all, or it has digits and six
    characters at least; so are digits beyond 0-9 where they vary, patterns of over 500 characters, and those in ``known``
    (pattern). Only texts of 3 to 80 characters that were not rejected count, each with the category it had first; the most
    common category wins, the earlier on ties. Rows without a text are no values."""
    c = F.col
    v = redactions.where("source = 'user' and type = 'text' and status <> 'rejected'").select("seq", "category", ws_trim(c("text")).alias("value"))
    v = v.where(F.length("value").between(3, 80)).groupBy("value").agg(F.min("seq").alias("seq"), F.min_by("category", "seq").alias("category"))
    v = v.withColumn("_t", F.regexp_extract_all("value", F.lit(rf"(?s)\p{{Nd}}+|\p{{L}}+|{SPACE}+|."), F.lit(0)))
    kind = lambda t: F.when(t.rlike(r"^\p{Nd}"), "d").when(t.rlike(r"^\p{L}"), "l").when(t.rlike(f"^{SPACE}"), "s").otherwise(F.concat(F.lit("s:"), t))
    v = v.withColumn("signature", F.array_join(F.transform("_t", kind), "|"))
    votes = v.groupBy("signature", "category").agg(F.count("*").alias("n"), F.min("seq").alias("seq"), F.min_by("value", "seq").alias("value"))
    best = votes.groupBy("signature").agg(F.max_by("category", F.struct("n", (-c("seq")).alias("s"))).alias("category"), F.sum("n").alias("support"), F.min_by("value", "seq").alias("first")).where(c("support") >= max(least, 2))
    runs = v.select("signature", F.posexplode("_t").alias("at", "t"))
    every = lambda rule: F.bool_and(c("t").rlike(rule))
    runs = runs.groupBy("signature", "at").agg(
        F.min("t").alias("a"), F.max("t").alias("z"), F.min(F.length("t")).alias("low"), F.max(F.length("t")).alias("high"), every("^[0-9]+$").alias("plain"), every("^[A-Za-z]+$").alias("ascii"), every("^[A-Z]+$").alias("upper"), every("^[a-z]+$").alias("lower"),
    ).withColumn("cls", kind(c("a")))
    same, digits, letters = c("a") == c("z"), c("cls") == "d", c("cls") == "l"
    # the beginning that the first and the last in order share is shared by all
    common = F.size(F.filter(F.sequence(F.lit(1), c("high")), lambda n: (n <= c("low")) & (F.substring(c("a"), F.lit(1), n) == F.substring(c("z"), F.lit(1), n))))
    runs = runs.withColumn("head", F.substring(c("a"), F.lit(1), common)).withColumn("_c", F.length("head"))
    letter = F.when(~c("ascii"), r"\p{L}").when(c("upper"), "[A-Z]").when(c("lower"), "[a-z]").otherwise("[A-Za-z]")
    part = F.when(c("cls") == "s", r"\s+").when(digits & ~same, F.concat("head", F.lit(r"\d"), _times(c("low") - c("_c"), c("high") - c("_c")))).when(letters & ~same, F.concat(letter, _times(c("low"), c("high")))).otherwise(_escaped(c("a")))
    shown = F.when(c("cls") == "s", " ").when(digits & ~same, F.concat("head", F.repeat(F.lit("x"), F.greatest(F.lit(1), c("low") - c("_c"))))).otherwise(c("a"))
    fixed_length = F.when((digits | letters) & same, F.length("a")).when(digits, c("_c")).otherwise(0)
    shapes = runs.groupBy("signature").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", part.alias("p")))), lambda x: x["p"]), "").alias("pattern"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", shown.alias("p")))), lambda x: x["p"]), "").alias("display"),
        F.sum(fixed_length).alias("literal"), F.bool_or(digits).alias("digits"), F.sum("low").alias("least"), F.bool_or(letters & ~same).alias("vary"), F.bool_or(digits & ~same & ~c("plain")).alias("odd"),
    )
    out = best.join(shapes, "signature").where(((c("literal") >= 2) | (c("digits") & (c("least") >= 6))) & ~c("odd") & (F.length("pattern") <= MAX_LENGTH))
    if known is not None:
        out = out.join(known.select("pattern"), "pattern", "left_anti")
    return out.select("signature", "pattern", "category", "support", F.when(c("vary"), c("first")).otherwise(c("display")).alias("display"))
