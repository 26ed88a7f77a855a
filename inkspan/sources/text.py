"""Plain text and delimited files: lines with offsets, pages, grids, cells and what is written back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkspan.batches import pieces
from inkspan.functions.text import quote_field

PAGE_CHARS, MAX_CHARS, MAX_ROWS, MAX_COLUMNS = 3000, 8_000_000, 200_000, 2048
CHUNK_CHARS = 6000


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0), start, text: CRLF, CR and LF end lines; an empty last line is none."""
    ends = r"(?<=\r\n)|(?<=\n)(?<!\r\n)|(?<=\r)(?!\n)"
    rows = docs.select("doc_id", F.split("text", ends).alias("_l"))
    rows = rows.select("doc_id", F.posexplode(F.filter("_l", lambda x: x != "")).alias("line", "text"))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    return rows.select("doc_id", "line", "start", F.regexp_replace("text", r"[\r\n]+\z", "").alias("text"))


def paginate_text(text: str, most: int = PAGE_CHARS) -> list[tuple[str, int]]:
    """(page text, offset in the source): lines go to a page until it would exceed ``most``; each gets a line feed."""
    pages, own, used, start, at = [], [], 0, 0, 0
    for line in text.splitlines(keepends=True) if not set(text) & set("\x0b\x0c\x1c\x1d\x1e\x85  ") else _lines(text):
        body = line.rstrip("\r\n") + "\n"
        if used and used + len(body) > most:
            pages.append(("".join(own), start))
            own, used, start = [], 0, at
        own.append(body)
        used += len(body)
        at += len(line)
    pages.append(("".join(own), start))
    return pages


def _lines(text: str) -> list[str]:
    import re

    return re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", text)


def paginate(docs: DataFrame, most: int = PAGE_CHARS, keep: str | None = None) -> DataFrame:
    """doc_id, page (from 1), page_start, text and, if named, a column that pages take from their document; every document
    has a page. Texts over 8,000,000 characters are refused."""
    extra = [] if keep is None else [keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            rows, own = [], []
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if len(text or "") > MAX_CHARS:
                    raise ValueError(f"document {doc} has over {MAX_CHARS} characters")
                pages = paginate_text(text or "", most)
                rows += [(doc, n + 1, s, t) for n, (t, s) in enumerate(pages)]
                own += [i] * len(pages)
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, *(b.column(2).take(pa.array(own, pa.int64())) for _ in extra)], names=["doc_id", "page", "page_start", "text", *extra])

    kinds = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in extra)
    return docs.select(F.col("doc_id").cast("long"), "text", *extra).mapInArrow(run, "doc_id long, page int, page_start int, text string" + kinds)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())])))
def chunk_text(text: pd.Series) -> pd.Series:
    """Chunks of at most CHUNK_CHARS characters, cut after the last line break past half, else hard."""

    def cut(t: str) -> list[dict]:
        out, at = [], 0
        while at < len(t):
            end = min(at + CHUNK_CHARS, len(t))
            if end < len(t) and (nl := t.rfind("\n", at + CHUNK_CHARS // 2, end)) >= 0:
                end = nl + 1
            out.append({"start": at, "text": t[at:end]})
            at = end
        return out

    return text.fillna("").map(cut)


def parse_delimited_text(text: str, delimiter: str = ",") -> list[list[tuple[str, bool]]]:
    """Rows of (value, was quoted). Quotes open only at the start of a field, ``""`` is a quote in one; CR, LF and CRLF
    end rows. Raises ValueError where a quote is never closed."""
    rows, row, at, n = [], [], 0, len(text)
    fresh = False  # a row has begun
    while at < n or fresh:
        fresh = False
        if at < n and text[at] == '"':
            parts, at = [], at + 1
            while True:
                q = text.find('"', at)
                if q < 0:
                    raise ValueError("a quoted field is never closed")
                parts.append(text[at:q])
                at = q + 1
                if text[at : at + 1] != '"':
                    break
                parts.append('"')
                at += 1
            end = at
            while end < n and text[end] not in (delimiter, "\r", "\n"):
                end += 1
            row.append(("".join(parts) + text[at:end], True))
        else:
            end = at
            while end < n and text[end] not in (delimiter, "\r", "\n"):
                end += 1
            row.append((text[at:end], False))
        at = end
        if at < n and text[at] == delimiter:
            at, fresh = at + 1, True
            continue
        rows.append(row)
        row = []
        at += 2 if text[at : at + 2] == "\r\n" else 1
    return rows


def _cells(text: str | None, delimiter: str) -> list[tuple]:
    """(row, col, value, quoted) of a text's filled cells; ValueError where it is refused."""
    grid = parse_delimited_text((text or "").removeprefix("\ufeff"), delimiter)
    if len(grid) > MAX_ROWS:
        raise ValueError(f"over {MAX_ROWS} rows")
    if any(v for row in grid for v, _ in row[MAX_COLUMNS:]):
        raise ValueError(f"over {MAX_COLUMNS} columns")
    return [(r + 1, c + 1, v, q) for r, row in enumerate(grid) for c, (v, q) in enumerate(row) if v]


def _grids(docs: DataFrame, delimiter: str, strict: bool) -> DataFrame:
    """Cells with a null reason; a refused document is a row with a reason, or an error if strict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string())
        for b in pieces(batches, 1):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [(doc, *cell, None) for cell in _cells(text, delimiter)]
                except ValueError as e:
                    if strict:
                        raise ValueError(f"document {doc}: {e}") from None
                    out.append((doc, None, None, None, None, str(e)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "row", "col", "value", "quoted", "reason"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, row int, col int, value string, quoted boolean, reason string")


def delimited_cells(docs: DataFrame, delimiter: str = ",") -> DataFrame:
    """doc_id, row, col (from 1), value, quoted: the filled cells of delimited texts. Over 200,000 rows, a filled cell past
    column 2,048 or an open quote end the job; ``read_grids`` sets such documents aside instead."""
    return _grids(docs, delimiter, True).drop("reason")


def read_grids(docs: DataFrame, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """(cells, refused): cells as of ``delimited_cells``; refused documents, which have no cells, as doc_id, reason. Each
    side parses the texts when it is read."""
    rows = _grids(docs, delimiter, False)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("doc_id", "reason")


def read_pages(docs: DataFrame, most: int = PAGE_CHARS, keep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, refused): pages as of ``paginate``; documents over its limit as doc_id, reason."""
    long = F.coalesce(F.length("text"), F.lit(0)) > MAX_CHARS
    return paginate(docs.where(~long), most, keep), docs.where(long).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(f"over {MAX_CHARS} characters").alias("reason"))


def write_rows(cells: DataFrame, delimiter: str = ",", value: str = "value") -> DataFrame:
    """doc_id, row, line: the cells of each row, quoted where they were or must be, with gaps as empty fields."""
    field = quote_field(F.coalesce(F.col(value), F.lit("")), delimiter, F.coalesce(F.col("quoted"), F.lit(False)))
    rows = cells.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", field.alias("v")))).alias("m"), F.max("col").alias("n"))
    return rows.select("doc_id", "row", F.array_join(F.expr("transform(sequence(1, n), i -> coalesce(m[i], ''))"), delimiter).alias("line"))


def ocr_spans(words: DataFrame, floor: float = 0.5, scale: float = 1.0) -> DataFrame:
    """doc_id, page, seq, text, start, end, x, y, width, height of recognised words at or above a confidence, as they stand
    in the page's text joined by one space; boxes are scaled."""
    kept = words.where((F.col("confidence") >= floor) & (F.trim("text") != "")).withColumn("text", F.trim("text"))
    w = Window.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    return kept.select("doc_id", "page", "seq", "text", start.alias("start"), (start + F.length("text")).alias("end"), *((F.col(c) * scale).alias(c) for c in ("x", "y", "width", "height")))
