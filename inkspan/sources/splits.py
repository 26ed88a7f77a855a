"""Delimited texts and mailboxes of any size, read in pieces that different tasks hold.

A piece is (doc_id, seq, text): the texts of a document's pieces, in the order of seq, are its text. ``pieces_of_files`` makes
them of the splits that Spark reads a file in, ``pieces_of_texts`` of a column. No task holds more of a document than a
piece and, where a cell or message runs over pieces, that cell or message.

Delimited texts: what a piece means depends on whether it starts within quotes, so each piece is walked from every state
that the one before may end in. That gives a map from states to states with counts of rows and fields. Composing the maps in
the order of the pieces (rows of some hundred bytes) gives each piece its state, row and column, and then every piece emits
the cells that it holds wholly, without a shuffle; only cells that are open at a piece's edge are put together by place.

Mailboxes: pieces hold whole lines. Whether a line opens a message depends on the line before and the one after it, so a
piece counts its messages for each answer that its neighbours may give; a running sum numbers the messages.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspan.tables import kept

from .markup import _FIELD, _SEPARATOR, MAX_MESSAGES
from .text import MAX_COLUMNS, MAX_ROWS

#: Characters of a piece, about.
PIECE = 1 << 20
#: Pieces whose places are broadcast at most (some 60 bytes each); more are joined by a shuffle.
BROADCAST_PIECES = 500_000
BOM = "﻿"
#: Where a piece may start: at a field's start, in a field without quotes or after its closing quote, in quotes, after a
#: quote in quotes, after CR, at the start of the document (where a byte-order mark is skipped).
FIELD, PLAIN, QUOTED, QUOTE, RETURN, BEGIN = range(6)
# Control characters that no text holds.
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def pieces_of_files(spark: SparkSession, path: str, size: int = PIECE, encoding: str = "utf-8") -> DataFrame:
    """doc_id (the file's path), seq, text, total (bytes of the file), valid (whether the bytes are of that encoding; text
    is null else) for text files, cut at line ends. A file of no line has no piece. The last line of a file gets a line
    feed even if the file has none: the sum of the lengths then is total + 1."""
    kind = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("total"), F.col("value").cast("binary").alias("line"))
    names = ["doc_id", "seq", "text", "total", "valid", "n_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        place, number, used = (None, None, None), 0, 0

        def piece() -> pa.RecordBatch:
            raw = b"".join(held)
            try:
                text, valid = raw.decode(encoding), True
            except UnicodeDecodeError:
                text, valid = None, False
            row = [place[0], (place[1] << 20) + number, text, place[2], valid, len(raw)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=names)

        for b in batches:
            ends = [0, b.num_rows]
            if b.num_rows > 1:
                for c in (0, 1):
                    ends += [i + 1 for i in pc.indices_nonzero(pc.not_equal(b.column(c)[1:], b.column(c)[:-1])).to_pylist()]
            ends = sorted(set(ends))
            for i, j in zip(ends, ends[1:], strict=False):
                now = (b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py())
                if now != place:
                    if held:
                        yield piece()
                    place, number, held, used = now, 0, [], 0
                for line in b.column(3).slice(i, j - i).to_pylist():
                    held.append(line + b"\n")
                    used += len(line) + 1
                    if used >= size:
                        yield piece()
                        held, used, number = [], 0, number + 1
        if held:
            yield piece()

    return kind.mapInArrow(run, "doc_id string, seq long, text string, total long, valid boolean, n_bytes long")


def pieces_of_texts(docs: DataFrame, size: int = PIECE, at_lines: bool = True) -> DataFrame:
    """doc_id, seq, text for a text column; cut after the first line feed past ``size`` characters, or hard. A null or
    empty text is one empty piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cuts(text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            end = at + size
            if at_lines and end < len(text):
                end = text.find("\n", end - 1) + 1 or len(text)
            out.append(text[at:end])
            at = end
        return out or [""]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a row at a time: texts are large
                own = cuts(b.column(1)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(own), b.schema.field(0).type), pa.array(range(len(own)), pa.int64()), pa.array(own, pa.string())], names=["doc_id", "seq", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, seq long, text string")


def walk(text: str, state: int, stop: re.Pattern) -> Iterator[tuple[str, bool, int, str, int]]:
    """(value, quoted, where it starts, the character that ends it, where the next field starts) for each field that ends in
    the text, and last what is open at its end, with "" as the character and the state in place of the next start."""
    at, n = 0, len(text)
    if state == RETURN and text[:1] == "\n":
        at = 1
    elif state == BEGIN and text[:1] == BOM:
        at = 1
    if state in (RETURN, BEGIN) and n:
        state = FIELD
    start, parts, quoted = at, [], state in (QUOTED, QUOTE)
    while True:
        if state in (FIELD, RETURN, BEGIN):
            if at >= n:
                break
            if text[at] == '"':
                state, quoted, at = QUOTED, True, at + 1
            else:
                state = PLAIN
        elif state == QUOTED:
            q = text.find('"', at)
            if q < 0:
                parts.append(text[at:])
                break
            parts.append(text[at:q])
            state, at = QUOTE, q + 1
        elif state == QUOTE:
            if at >= n:
                break
            if text[at] == '"':
                parts.append('"')
                state, at = QUOTED, at + 1
            else:
                state = PLAIN
        else:
            m = stop.search(text, at)
            if m is None:
                parts.append(text[at:])
                break
            parts.append(text[at : m.start()])
            end, at = m.group(), m.end()
            state = FIELD
            if end == "\r":
                if at >= n:
                    state = RETURN
                elif text[at] == "\n":
                    at += 1
            yield "".join(parts), quoted, start, end, at
            start, parts, quoted = at, [], False
    yield "".join(parts), quoted, start, "", state


def maps(text: str, stop: re.Pattern) -> list[tuple[int, int, int, int, int, int]]:
    """For each state at the start: (state at the end, rows ended, fields of the first row, most fields of a later row, fields
    since the last row's end, where the field open at the end starts or -1 if it was open at the start).

    The walk from FIELD is recorded; walks from other states end where they meet it, usually after a field."""
    ats, rows, widths, k, last = [], [], [], 0, None
    for _, _, start, end, at in walk(text, FIELD, stop):
        if not end:
            last = (at, start)
            break
        ats.append(at)
        k += 1
        if end in "\r\n":
            rows.append(len(ats) - 1)
            widths.append(k)
            k = 0
    most = [0] * (len(widths) + 1)
    for i in range(len(widths) - 1, -1, -1):
        most[i] = max(most[i + 1], widths[i])
    known, out = {at: i for i, at in enumerate(ats)}, []
    for state in range(6):
        n = first = widest = own = 0
        for _, _, start, end, at in walk(text, state, stop):
            if not end:
                out.append((at, n, first, widest, own, start if n or own else -1))
                break
            own += 1
            if end in "\r\n":
                n, first, widest, own = n + 1, first if n else own, max(widest, own) if n else 0, 0
            if (i := known.get(at)) is not None:
                j = bisect_right(rows, i)
                before = ats and (i - (rows[j - 1] if j else -1))  # fields that the recorded walk has of the row in progress
                if j < len(rows):
                    width = own + widths[j] - before
                    first, widest = (first, max(widest, width, most[j + 1])) if n else (width, most[j + 1])
                    own = k
                else:
                    own += k - before
                out.append((last[0], n + len(rows) - j, first, widest, own, last[1]))
                break
    return out


def _summaries(pieces: DataFrame, delimiter: str) -> DataFrame:
    kind = pieces.schema["doc_id"].dataType.simpleString()
    stop = re.compile(f"[{re.escape(delimiter)}\r\n]")
    columns = [c if c in pieces.columns else F.lit(v).cast(t).alias(c) for c, v, t in (("valid", True, "boolean"), ("total", None, "long"), ("n_bytes", 0, "long"))]
    names = ["doc_id", "seq", "valid", "control", "size", "total", "n_bytes", "bom", "ends", "breaks", "maps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.int64()))
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                text, valid = b.column(2)[i].as_py() or "", b.column(3)[i].as_py()
                nl = text.find("\n")
                breaks = "" if nl < 0 else "?" if nl == 0 else "\r\n" if text[nl - 1] == "\r" else "\n"
                flat = [v for m in maps(text, stop) for v in m]
                rows.append((valid, bool(CONTROL.search(text)), len(text), b.column(4)[i].as_py(), b.column(5)[i].as_py(), text[:1] == BOM, text[-1:], breaks, flat))
            columns_ = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns_, kinds, strict=True))], names=names)

    return pieces.select("doc_id", F.col("seq").cast("long"), "text", *columns).mapInArrow(run, f"doc_id {kind}, seq long, valid boolean, control boolean, size long, total long, n_bytes long, bom boolean, ends string, breaks string, maps array<long>")


class _Document:
    """A document's state while its pieces' maps are composed."""

    def __init__(self, doc):
        self.doc, self.state, self.row, self.col, self.widest, self.valid, self.control, self.bom = doc, BEGIN, 0, 0, 0, True, False, False
        self.last, self.eol, self.chars, self.bytes, self.total = "", None, 0, 0, None

    def step(self, r: dict) -> tuple:
        """The place where the piece starts; then the document is at its end."""
        state, rows, first, widest, own, tail = r["maps"][6 * self.state : 6 * self.state + 6]
        mark = self.state == BEGIN and r["bom"]
        placed = (self.doc, r["seq"], self.state, self.row, self.col, tail, state)
        if rows:
            self.widest, self.row, self.col = max(self.widest, self.col + first, widest), self.row + rows, own
        else:
            self.col += own
        if self.eol is None and r["breaks"]:
            self.eol = r["breaks"] if r["breaks"] != "?" else "\r\n" if self.last == "\r" else "\n"
        self.state, self.valid, self.control = state, self.valid and r["valid"], self.control or r["control"]
        self.last, self.chars, self.bytes, self.total = r["ends"] or self.last, self.chars + r["size"] - mark, self.bytes + r["n_bytes"], r["total"]
        self.bom = self.bom or mark
        return (*placed, self.row, self.col)

    def end(self, most: int | None) -> tuple:
        """(rows, columns, columns left out, line end, byte-order mark, whether the last row has a line end, why it is refused) of the whole document."""
        closed = self.last in ("\r", "\n")
        rows, widest = self.row, self.widest
        if self.chars and not closed:
            rows, widest = rows + 1, max(widest, self.col + 1)
        trailing = closed and self.bytes != (self.total or 0) + 1 if self.total is not None else bool(self.chars) and closed
        reason = "not valid UTF-8" if not self.valid else "control characters" if self.control else "a quoted field is never closed" if self.state == QUOTED else f"over {most} rows" if most is not None and rows > most else None
        return rows, min(widest, MAX_COLUMNS), max(0, widest - MAX_COLUMNS), self.eol or "\n", self.bom, trailing, reason


def _places(summaries: DataFrame, most: int | None) -> DataFrame:
    """The pieces with where they start, and on each document's last piece what the document is."""
    kind = summaries.schema["doc_id"].dataType.simpleString()
    fields = [("seq", pa.int64()), ("state", pa.int32()), ("row", pa.int64()), ("col", pa.int64()), ("tail", pa.int64()), ("after", pa.int32()), ("end_row", pa.int64()), ("end_col", pa.int64()), ("rows", pa.int64()), ("columns", pa.int32()), ("left_out", pa.int64()), ("eol", pa.string()), ("bom", pa.bool_()), ("trailing", pa.bool_()), ("reason", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, waiting = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if doc is None or r["doc_id"] != doc.doc:
                    if waiting:
                        out.append((*waiting, *doc.end(most)))
                    doc, waiting = _Document(r["doc_id"]), None
                if waiting:
                    out.append((*waiting, *[None] * 7))
                waiting = doc.step(r)
            yield batch(out, b.schema)
            schema = b.schema
        if waiting:
            yield batch([(*waiting, *doc.end(most))], schema)

    def batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 16
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [schema.field(0).type, *(t for _, t in fields)], strict=True)], names=["doc_id", *(n for n, _ in fields)])

    ordered = summaries.repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return ordered.mapInArrow(run, f"doc_id {kind}, seq long, state int, row long, col long, tail long, after int, end_row long, end_col long, rows long, columns int, left_out long, eol string, bom boolean, trailing boolean, reason string")


def _placed(pieces: DataFrame, places: DataFrame) -> DataFrame:
    places = F.broadcast(places) if places.count() <= BROADCAST_PIECES else places
    return pieces.join(places, ["doc_id", "seq"])


class Grids:
    """Delimited texts in pieces, walked once: ``grids`` (doc_id, rows, columns, left_out, eol, bom, trailing, reason), one row per
    document, where reason says why it is refused and left_out how many columns lie past the 2,048th; ``cells``. ``most``: rows that a
    document may have; None is no limit."""

    def __init__(self, pieces: DataFrame, delimiter: str = ",", most: int | None = MAX_ROWS):
        self.pieces, self.delimiter = pieces, delimiter
        self.places = kept(_places(_summaries(pieces, delimiter), most), "places")
        self.grids = self.places.where("rows is not null").select("doc_id", "rows", "columns", "left_out", "eol", "bom", "trailing", "reason")

    def cells(self) -> DataFrame:
        """doc_id, row, col (from 1), value, quoted: the filled cells of documents that are not refused."""
        refused = self.grids.where("reason is not null").select("doc_id")
        places = self.places.select("doc_id", "seq", "state", "row", "col", "tail", "after", "end_row", "end_col").join(refused, "doc_id", "left_anti")
        rows = _placed(self.pieces.select("doc_id", "seq", "text"), kept(places, "placed"))
        whole = self._emit(rows, False).drop("seq")
        edges = self._emit(rows.where(f"state in ({PLAIN}, {QUOTED}, {QUOTE}) or after in ({PLAIN}, {QUOTED}, {QUOTE})"), True)
        parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda p: p["value"])
        joined = edges.groupBy("doc_id", "row", "col").agg(F.array_join(parts, "").alias("value"), F.bool_or("quoted").alias("quoted"))
        return whole.unionByName(joined).where("value != ''")

    def _emit(self, rows: DataFrame, edges: bool) -> DataFrame:
        """The fields that end in their piece, or the parts of those that run over its edges."""
        kind, stop, open_ = rows.schema["doc_id"].dataType.simpleString(), re.compile(f"[{re.escape(self.delimiter)}\r\n]"), (PLAIN, QUOTED, QUOTE)

        def whole(text: str, state: int, row: int, col: int) -> Iterator[tuple]:
            for i, (value, quoted, _, end, _) in enumerate(walk(text, state, stop)):
                if end and value and not (i == 0 and state in open_):
                    yield row, col, value, quoted
                row, col = (row + 1, 0) if end and end in "\r\n" else (row, col + 1)

        def parts(text: str, state: int, row: int, col: int, tail: int, after: int, end_row: int, end_col: int) -> Iterator[tuple]:
            if state in open_ or tail < 0:
                yield row, col, *next(walk(text, state, stop))[:2]
            if tail >= 0 and after in open_:
                yield end_row, end_col, *next(walk(text[tail:], FIELD, stop))[:2]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.bool_())
            for b in batches:
                at, own = [], []

                def made(b=b) -> pa.RecordBatch:
                    places = pa.array(at, pa.int64())
                    r, c, *rest = zip(*own, strict=True) if own else [[]] * 4
                    columns = ([x + 1 for x in r], [x + 1 for x in c], *rest)
                    return pa.RecordBatch.from_arrays([b.column(0).take(places), b.column(1).take(places).cast(pa.int64()), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["doc_id", "seq", "row", "col", "value", "quoted"])

                for i in range(b.num_rows):
                    text, state, row, col, tail, after, end_row, end_col = (b.column(c)[i].as_py() for c in range(2, 10))
                    found = parts(text or "", state, row, col, tail, after, end_row, end_col) if edges else whole(text or "", state, row, col)
                    found = (f for f in found if f[1] < MAX_COLUMNS)
                    while some := list(islice(found, 50_000)):
                        own += some
                        at += [i] * len(some)
                        if len(own) >= 50_000:
                            yield made()
                            at, own = [], []
                yield made()

        return rows.select("doc_id", "seq", "text", "state", "row", "col", "tail", "after", "end_row", "end_col").mapInArrow(run, f"doc_id {kind}, seq long, row long, col int, value string, quoted boolean")


def openings(text: str) -> Iterator[tuple[int, int, bool, bool]]:
    """(start, end, needs the line before, needs the line after) of lines that open a message as far as the piece tells."""
    for m in re.finditer(r"^From [^\n]*", text, re.M):
        start, end = m.start(), m.end() + 1
        if not _SEPARATOR.match(m.group().rstrip("\r")) or end > len(text):
            continue  # the last line of all opens none
        if start and text[text.rfind("\n", 0, start - 1) + 1 : start].strip("\r\n"):
            continue
        if end == len(text) or _FIELD.match(text, end):
            yield start, end, start == 0, end == len(text)


class Mailboxes:
    """Mailboxes in pieces of whole lines: ``refused`` (doc_id, reason) and ``messages``."""

    def __init__(self, pieces: DataFrame, most: int | None = MAX_MESSAGES):
        kind = pieces.schema["doc_id"].dataType.simpleString()
        extra = [c if c in pieces.columns else F.lit(None).cast("long").alias(c) for c in ("total", "n_bytes")]
        self.pieces = pieces.where("text != ''").select("doc_id", F.col("seq").cast("long"), "text", *extra)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for i in range(b.num_rows):
                    text = b.column(2)[i].as_py()
                    found = list(openings(text))
                    count = [sum(1 for _, _, x, y in found if (x, y) == w) for w in ((False, False), (True, False), (False, True), (True, True))]
                    blank = not text[text.rfind("\n", 0, len(text) - 1) + 1 :].strip("\r\n")
                    rows.append((*count, blank, bool(_FIELD.match(text))))
                kinds = (*[pa.int32()] * 4, pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True))], names=["doc_id", "seq", "total", "n_bytes", "inner", "after", "before", "both", "blank", "field"])

        each = self.pieces.mapInArrow(run, f"doc_id {kind}, seq long, total long, n_bytes long, inner int, after int, before int, both int, blank boolean, field boolean")
        w = Window.partitionBy("doc_id").orderBy("seq")
        each = each.select("*", F.coalesce(F.lag("blank").over(w), F.lit(True)).alias("_blank"), F.lead("field").over(w).alias("_field"))
        each = each.withColumn("_next", F.coalesce("_field", F.lit(False)))
        n = F.col("inner") + F.when(F.col("_blank"), F.col("after")).otherwise(0) + F.when(F.col("_next"), F.col("before")).otherwise(0) + F.when(F.col("_blank") & F.col("_next"), F.col("both")).otherwise(0)
        run_ = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        each = each.withColumn("opened", n).select("*", (F.sum("opened").over(run_) - F.col("opened")).alias("base"), F.sum("n_bytes").over(run_).alias("_bytes"))
        # only the last line of a file can have a line feed that the file has not
        added = F.col("_field").isNull() & (F.col("_bytes") == F.col("total") + 1)
        self.places = kept(each.select("doc_id", "seq", "opened", "base", F.col("_blank").alias("blank"), F.col("_next").alias("next"), F.coalesce(added, F.lit(False)).alias("added")), "mailboxes")
        total = self.places.groupBy("doc_id").agg(F.sum("opened").alias("n"))
        many = F.lit(False) if most is None else F.col("n") > most
        self.refused = total.where(many | (F.col("n") == 0)).select("doc_id", F.when(F.col("n") == 0, "no messages").otherwise(f"over {most} messages").alias("reason"))

    def messages(self) -> DataFrame:
        """doc_id, message (from 1), from_line, text: without the blank line that ends a message, and with one ``>`` taken off
        quoted From lines."""
        places = kept(self.places.join(self.refused, "doc_id", "left_anti"), "mailboxes")
        rows = _placed(self.pieces.select("doc_id", "seq", "text"), places)
        whole = self._emit(rows, False)
        first = F.max("from_line")  # one part has it
        body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "")
        joined = self._emit(rows, True).groupBy("doc_id", "message").agg(first.alias("from_line"), body.alias("text"))
        text = F.regexp_replace("text", r"(?:(?<=\n)|\A)(?:\r*\n|\r+)\z", "")
        return whole.drop("seq").unionByName(joined).withColumn("text", F.regexp_replace(text, r"(?dm)^>(>*From )", "$1"))

    def _emit(self, rows: DataFrame, edges: bool) -> DataFrame:
        kind = rows.schema["doc_id"].dataType.simpleString()

        def cut(text: str, base: int, blank: bool, next_: bool) -> Iterator[tuple]:
            """(message, from_line, text, whether it may go on in other pieces)"""
            found = [(a, z) for a, z, before, after in openings(text) if (blank or not before) and (next_ or not after)]
            ends = [a for a, _ in found] + [len(text)]
            if base and ends[0]:
                yield base, None, text[: ends[0]], True
            for k, (a, z) in enumerate(found):
                yield base + k + 1, text[a:z].rstrip("\r\n"), text[z : ends[k + 1]], k + 1 == len(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    seq, text, base, blank, next_, added = (b.column(c)[i].as_py() for c in range(1, 7))
                    own = [m[:3] for m in cut(text[:-1] if added else text, base, blank, next_) if m[3] == edges]
                    same = pa.array([b.column(0)[i].as_py()] * len(own), b.schema.field(0).type), pa.array([seq] * len(own), pa.int64())
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(zip(*own, strict=True) if own else [[]] * 3, (pa.int32(), pa.string(), pa.string()), strict=True))], names=["doc_id", "seq", "message", "from_line", "text"])

        return rows.select("doc_id", "seq", "text", "base", "blank", "next", "added").mapInArrow(run, f"doc_id {kind}, seq long, message int, from_line string, text string")
