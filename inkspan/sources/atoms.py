r"""HTML and RTF as visible text with a map back to the source, and redaction of the source through that map.

The map is piecewise: an atom says which characters of the text come from which of the source. In a ``literal`` atom they
are the same, one by one (but a line break or tab shows as a space); a ``whole`` atom is one character that several stand for (an entity, an escape with its
fallback, a run of white space) and goes whole or not at all; a ``mark`` was put in by the reader and has no source. Spans
of the text meet the atoms that they touch by a binned join and give ranges of the source; all that lies outside of
them, tags between the letters of a name too, stays as it was.

Defined cases: null is the empty text without atoms; a tag that never ends hides the rest; groups of RTF deeper than 128
are refused with a reason; spans over marks alone cut nothing; a value of several ranges is replaced at the first one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkspan.batches import pieces
from inkspan.functions import fixed
from inkspan.operators.matching import value_places
from inkspan.operators.spans import merged_runs, overlap_join
from inkspan.tables import kept

from .markup import _RTF, ATTRIBUTES, BLOCKS, HIDDEN, RTF_DEPTH, RTF_SKIPPED, RTF_SYMBOLS, encode_entities

_TAG = re.compile(r"<(/?)\s*([a-zA-Z][a-zA-Z0-9]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
_MARKUP = re.compile("[<&]")
#: White space that is not one space as it stands; a single one is like any other character.
_RUN = re.compile(r"[ \t\r\n\f]{2,}|[\t\r\n\f]")


class Writer:
    """Text that knows where each character comes from: source bounds, -1 for none."""

    def __init__(self):
        self.parts: list[str] = []
        self.starts: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []

    def literal(self, text: str, start: int) -> None:
        at = np.arange(start, start + len(text), dtype=np.int64)
        self._put(text, at, at + 1)

    def whole(self, text: str, start: int, end: int) -> None:
        self._put(text, np.full(len(text), start, np.int64), np.full(len(text), end, np.int64))

    def mark(self, text: str) -> None:
        self.whole(text, -1, -1)

    def _put(self, text: str, starts: np.ndarray, ends: np.ndarray) -> None:
        if text:
            self.parts.append(text)
            self.starts.append(starts)
            self.ends.append(ends)

    def done(self) -> tuple[str, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return "".join(self.parts), np.concatenate([none, *self.starts]), np.concatenate([none, *self.ends])


def _kept(text: str, starts: np.ndarray, ends: np.ndarray, drop: list[tuple[int, int]]) -> tuple[str, np.ndarray, np.ndarray]:
    keep = np.ones(len(text), bool)
    for a, b in drop:
        keep[a:b] = False
    return "".join(c for c, k in zip(text, keep.tolist(), strict=True) if k) if not keep.all() else text, starts[keep], ends[keep]


def atoms_of(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """The atoms of a text by its characters' bounds."""
    n = len(starts)
    if not n:
        return []
    mark, literal = starts < 0, (ends - starts == 1) & (starts >= 0)
    follows = np.r_[False, (mark[1:] & mark[:-1]) | (literal[1:] & literal[:-1] & (starts[1:] == starts[:-1] + 1))]
    first = np.flatnonzero(~follows)
    last = np.r_[first[1:], n] - 1
    kinds = np.where(mark[first], "mark", np.where(literal[first], "literal", "whole"))
    rows = zip(kinds.tolist(), first.tolist(), (last + 1).tolist(), starts[first].tolist(), ends[last].tolist(), strict=True)
    return [dict(zip(("kind", "text_start", "text_end", "start", "end"), r, strict=True)) for r in rows]


def html_map(source: str) -> tuple[str, np.ndarray, np.ndarray, list[tuple[str, int, int]]]:
    """(visible text as light Markdown, its characters' bounds in the source, attributes that carry text with theirs)."""
    out, attributes, links, cells, at, n = Writer(), [], [], 0, 0, len(source)
    while at < n:
        if source[at] == "&":
            m = _ENTITY.match(source, at)
            value = html.unescape(m.group()) if m else "&"
            if m and value != m.group():
                out.whole(value, at, m.end())
                at = m.end()
            else:
                out.literal("&", at)
                at += 1
            continue
        if source[at] != "<":
            end = m.start() if (m := _MARKUP.search(source, at)) else n
            for m in _RUN.finditer(source, at, end):
                out.literal(source[at : m.start()], at)
                out.whole(" ", m.start(), m.end())
                at = m.end()
            out.literal(source[at:end], at)
            at = end
            continue
        comment = source.startswith("<!--", at)
        end = source.find("-->" if comment else ">", at)
        if end < 0:
            break
        end += 3 if comment else 1
        m = None if comment else _TAG.match(source, at)
        if m:
            closing, name = bool(m[1]), m[2].lower()
            own = [] if closing else [(a[1].lower(), a[k], a.start(k), a.end(k)) for a in _ATTRIBUTE.finditer(source, m.end(), end - 1) for k in (2, 3, 4) if a[k]]
            attributes += [a[1:] for a in own if a[0] in ATTRIBUTES]
            if name in HIDDEN and not closing:
                close = re.compile(f"</{name}", re.I).search(source, end)
                end = close.start() if close else n
            elif name == "br":
                out.mark("\n")
            elif name in ("td", "th"):
                if not closing:
                    out.mark(" | " if cells else "| ")
                    cells += 1
            elif name == "a":
                if not closing:
                    links.append(next((a[1:] for a in own if a[0] == "href"), None))
                    if links[-1]:
                        out.mark("[")
                elif links and (href := links.pop()):
                    out.mark("](")
                    out.literal(href[0], href[1])
                    out.mark(")")
            elif name in BLOCKS:
                if closing:
                    out.mark((" |" if name == "tr" and cells else "") + "\n")
                else:
                    out.mark("\n" + ("#" * int(name[1]) + " " if re.fullmatch("h[1-6]", name) else "- " if name == "li" else ""))
                    cells = 0 if name == "tr" else cells
        at = end
    text, starts, ends = out.done()
    drop = []
    for m in re.finditer(r" *\n *", text):
        nl = text.index("\n", m.start())
        drop += [(m.start(), nl), (nl + 1, m.end())]
    text, starts, ends = _kept(text, starts, ends, drop)
    text, starts, ends = _kept(text, starts, ends, [(m.start() + 2, m.end()) for m in re.finditer(r"\n{3,}", text)])
    return *_kept(text, starts, ends, [(0, len(text) - len(text.lstrip())), (len(text.rstrip()), len(text))]), attributes


def rtf_map(source: str) -> tuple[str, np.ndarray, np.ndarray]:
    """(visible text, its characters' bounds in the source); an escape has its fallback characters with it."""
    out, stack, skip, unicode_skip, eat = Writer(), [], False, 1, 0
    held: list | None = None  # a character of \u that waits for its fallback, or for the other half of its pair

    def flush() -> None:
        nonlocal held
        if held:
            out.whole(held[0].encode("utf-16", "surrogatepass").decode("utf-16", "replace"), held[1], held[2])
        held = None

    for m in _RTF.finditer(source):
        word, number, code, symbol, brace, plain = m.groups()
        if eat and held and (code or plain) and not skip:
            used = min(eat, len(plain)) if plain else 1
            eat -= used
            held[2] = m.start() + used if plain else m.end()
            if plain and used < len(plain):
                flush()
                out.literal(plain[used:], m.start() + used)
            continue
        if not (word == "u" and number and held and "\ud800" <= held[0][-1] <= "\udbff"):
            flush()
            eat = 0 if not (word == "u" and number) else eat
        if brace == "{":
            if len(stack) >= RTF_DEPTH:
                raise ValueError("groups are nested too deeply")
            stack.append((skip, unicode_skip))
        elif brace == "}":
            skip, unicode_skip = stack.pop() if stack else (False, 1)
        elif word:
            if word in RTF_SKIPPED:
                skip = True
            elif word == "uc":
                unicode_skip = int(number or 1)
            elif word == "u" and number and not skip:
                one = chr(int(number) % 65536)
                held = [held[0] + one, held[1], m.end()] if held else [one, m.start(), m.end()]
                eat = unicode_skip
            elif word in RTF_SYMBOLS and not skip:
                out.whole(RTF_SYMBOLS[word], m.start(), m.end())
        elif code and not skip:
            out.whole(bytes([int(code, 16)]).decode("cp1252", "replace"), m.start(), m.end())
        elif symbol:
            if symbol == "*":
                skip = True
            elif not skip and symbol in "{}\\~_-":
                out.whole({"~": "\xa0", "_": "‑", "-": ""}.get(symbol, symbol), m.start(), m.end())
        elif plain and not skip:
            out.literal(plain, m.start())
    flush()
    return out.done()


_PLACE = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
_ATOMS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text_start", T.IntegerType()), T.StructField("text_end", T.IntegerType()), *_PLACE]))
_VALUES = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), *_PLACE]))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("atoms", _ATOMS), T.StructField("attributes", _VALUES)]))
def html_atoms(source: pd.Series) -> pd.DataFrame:
    rows = []
    for s in source:
        text, starts, ends, attributes = html_map(s or "")
        rows.append((text, atoms_of(starts, ends), [{"value": v, "start": a, "end": b} for v, a, b in attributes]))
    return pd.DataFrame(rows, columns=["text", "atoms", "attributes"], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("atoms", _ATOMS), T.StructField("reason", T.StringType())]))
def rtf_atoms(source: pd.Series) -> pd.DataFrame:
    rows = []
    for s in source:
        try:
            text, starts, ends = rtf_map(s or "")
            rows.append((text, atoms_of(starts, ends), None))
        except ValueError as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame(rows, columns=["text", "atoms", "reason"], dtype=object)


def on_text(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans of pages (doc_id, page, start, end) as spans of the document's text; pages as ``paginate`` gives them, of a text
    whose lines end in LF."""
    at = pages.select("doc_id", "page", "page_start")
    rows = spans.join(at, ["doc_id", "page"])
    return rows.withColumns({"start": F.col("start") + F.col("page_start"), "end": F.col("end") + F.col("page_start")}).drop("page_start")


def source_ranges(spans: DataFrame, mapped: DataFrame, label: str = fixed.LABEL) -> DataFrame:
    """doc_id, start, end, replacement in the source for spans of the text (doc_id, start, end, replacement, null for the
    label); mapped has doc_id and atoms. Overlapping spans are one, with the label where they differ."""
    one = (F.count("*") == F.count("replacement")) & (F.count_distinct("replacement") == 1)
    runs = merged_runs(spans, ["doc_id"]).groupBy("doc_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.when(one, F.first("replacement")).otherwise(label).alias("w"))
    atoms = mapped.select("doc_id", F.explode("atoms").alias("a")).where("a.kind != 'mark'").select("doc_id", F.col("a.text_start").alias("start"), F.col("a.text_end").alias("end"), F.col("a.kind").alias("kind"), F.col("a.start").alias("from"), F.col("a.end").alias("to"))
    both = overlap_join(runs, atoms, ["doc_id"])
    literal = F.col("r_kind") == "literal"
    start = F.when(literal, F.col("r_from") + F.greatest(F.col("start") - F.col("r_start"), F.lit(0))).otherwise(F.col("r_from"))
    end = F.when(literal, F.col("r_to") - F.greatest(F.col("r_end") - F.col("end"), F.lit(0))).otherwise(F.col("r_to"))
    parts = both.select("doc_id", "_run", "w", start.alias("start"), end.alias("end")).distinct()
    w = Window.partitionBy("doc_id", "_run").orderBy("start")
    new = F.coalesce(F.col("start") > F.lag("end").over(w), F.lit(True)).cast("int")
    parts = parts.withColumn("_new", new).withColumn("_piece", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = parts.groupBy("doc_id", "_run", "_piece", "w").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return pieces.select("doc_id", "start", "end", F.when(F.col("_piece") == 1, F.col("w")).otherwise("").alias("replacement"))


def cut_source(docs: DataFrame, ranges: DataFrame, source: str, to: str = "redacted", escape=encode_entities) -> DataFrame:
    """docs with the source less the ranges (doc_id, start, end, replacement); ranges that overlap are one, with the first
    replacement. ``escape`` writes a replacement as mark-up."""
    lists = ranges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", escape(F.coalesce("replacement", F.lit(""))).alias("w")))).alias("_cuts"))
    rows = docs.join(lists, "doc_id", "left")
    rest = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, cuts in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                text, at, parts = text.as_py(), 0, []
                for c in cuts.as_py() or []:
                    if c["start"] >= at:
                        parts += [text[at : c["start"]], c["w"]]
                    at = max(at, c["end"])
                out.append(None if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.string())], names=[*rest, to])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.select(*rest, F.col(source).alias("_source"), "_cuts").mapInArrow(run, f"{kinds}, `{to}` string")


def rtf_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\{}])", r"\\$1")


def read_html(docs: DataFrame, source: str = "html") -> DataFrame:
    """doc_id and _h (text, atoms, attributes) of docs, as a table: several plans take them, and the reading is what costs."""
    place = [("start", pa.int32()), ("end", pa.int32())]
    atom = pa.struct([("kind", pa.string()), ("text_start", pa.int32()), ("text_end", pa.int32()), *place])
    kind = pa.struct([("text", pa.string()), ("atoms", pa.list_(atom)), ("attributes", pa.list_(pa.struct([("value", pa.string()), *place])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            rows = html_atoms.func(pd.Series(b.column(1).to_pylist(), dtype=object)).to_dict("records")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "_h"])

    schema = docs.select("doc_id", html_atoms(source).alias("_h")).schema
    return kept(docs.select("doc_id", source).mapInArrow(run, schema), "html")


def redact_html(docs: DataFrame, values: DataFrame, source: str = "html", label: str = fixed.LABEL, to: str = "redacted", read: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, source) with all places of their own values (doc_id, value, replacement if there) cut out of the HTML: of
    its text through the atoms, and of attributes that carry text. read: ``read_html`` of the docs, where it is there."""
    read = read_html(docs, source) if read is None else read
    payload = F.col("replacement") if "replacement" in values.columns else F.lit(None).cast("string")
    found = value_places(read.select("doc_id", F.col("_h.text").alias("text")), values, payload=payload).select("doc_id", "start", "end", F.col("payload").alias("replacement"))
    ranges = source_ranges(found, read.select("doc_id", F.col("_h.atoms").alias("atoms")), label)
    shown = read.select("doc_id", F.explode("_h.attributes").alias("a")).select("doc_id", F.col("a.start").alias("at"), F.col("a.value").alias("text"))
    within = value_places(shown, values, payload=payload)
    within = within.select("doc_id", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), F.coalesce("payload", F.lit(label)).alias("replacement"))
    return cut_source(docs, ranges.unionByName(within), source, to)


def redact_rtf(docs: DataFrame, values: DataFrame, source: str = "rtf", label: str = fixed.LABEL, to: str = "redacted") -> DataFrame:
    """docs (doc_id, source) with all places of their own values cut out of the RTF; a refused document is null."""
    read = docs.select("doc_id", rtf_atoms(source).alias("_h"))
    payload = F.col("replacement") if "replacement" in values.columns else F.lit(None).cast("string")
    found = value_places(read.select("doc_id", F.col("_h.text").alias("text")), values, payload=payload).select("doc_id", "start", "end", F.col("payload").alias("replacement"))
    ranges = source_ranges(found, read.select("doc_id", F.col("_h.atoms").alias("atoms")), label)
    fine = docs.join(read.select(F.col("doc_id").alias("_d"), F.col("_h.reason").isNull().alias("_fine")), F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d")
    return cut_source(fine, ranges, source, to, rtf_escape).withColumn(to, F.when(F.col("_fine"), F.col(to))).drop("_fine")
