"""Each document's own values looked for in all its pages, cells or exports at once.

Values and the texts to search are brought to the same partitions by document and sorted so that a document's values come
first. A task makes an automaton of them and passes over the texts that follow once, whatever the number of values: no text
is copied for each value, and no values but a document's own are held. Documents with very many texts are dealt to
several parts, each of which gets a copy of the values.

Case does not matter; characters are folded one at a time, so that offsets hold. Of values with one folded form the first
(by ``seq``, else by the value) decides. Places are all occurrences, overlapping ones too.

Defined cases: null and empty texts and values have no places; a null doc_id is a document like any other; a text's
columns, whatever their names, pass as they are; a document without values keeps its texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.batches import cut, pieces
from inkspan.functions import fixed

#: Texts of a document that one task searches, about; documents of more go to several parts.
TEXTS = 4096
#: Split documents that are broadcast at most; more are joined by a shuffle.
BROADCAST_DOCUMENTS = 100_000


def fold(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


class Matcher:
    """An automaton of (value, payload) entries; ``every``: an occurrence stands for all values of its folded form, else
    for the first."""

    def __init__(self, entries: Sequence[tuple[str, str | None]], every: bool = False):
        import ahocorasick

        by: dict[str, list[tuple[str, str | None]]] = {}
        for value, payload in entries:
            if value and (every or fold(value) not in by):
                by.setdefault(fold(value), []).append((value, payload))
        self.machine = ahocorasick.Automaton() if by else None
        for form, own in by.items():
            self.machine.add_word(form, (len(form), own))
        if self.machine:
            self.machine.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, str, str | None]]:
        """(start, end, value, payload), by start and end."""
        if not self.machine or not text:
            return []
        return sorted(((e + 1 - n, e + 1, v, p) for e, (n, own) in self.machine.iter(fold(text)) for v, p in own), key=lambda h: h[:2])


def merged(hits: Sequence[tuple[int, int, str, str | None]]) -> list[tuple[int, int, str | None]]:
    """Ranges that overlap or touch as one: the first one's replacement, but nothing or the empty text where one of them says
    so."""
    out: list[list] = []
    for start, end, _, replacement in hits:
        if out and start <= out[-1][1]:
            last = out[-1]
            last[1] = max(last[1], end)
            if last[2] is not None and not replacement:
                last[2] = replacement
        else:
            out.append([start, end, replacement])
    return [tuple(x) for x in out]


def apart(hits: Sequence[tuple[int, int, str, str | None]]) -> list[tuple[int, int, str, str | None]]:
    """Of each value the occurrences that do not overlap one another, from the left."""
    ends: dict[str, int] = {}
    out = []
    for h in hits:
        if h[0] >= ends.get(h[2], 0):
            ends[h[2]] = h[1]
            out.append(h)
    return out


def _together(texts: DataFrame, values: DataFrame, text: str, payload: Column | None, keep: Sequence[str] | None = None) -> DataFrame:
    """Values (kind 0) and texts (kind 1) of a document in one partition, values first."""
    rows = texts.select("doc_id", F.struct(*(texts.columns if keep is None else keep)).alias("_row"), F.col(text).alias("_text"))
    order = F.col("seq").cast("long") if "seq" in values.columns else F.lit(0).cast("long")
    own = values.select("doc_id", F.col("value").alias("_text"), (F.lit(None) if payload is None else payload).cast("string").alias("_payload"), order.alias("_order")).where("_text != ''")
    large = rows.groupBy("doc_id").count().where(F.col("count") > TEXTS).select(F.col("doc_id").alias("_doc"), F.ceil(F.col("count") / TEXTS).cast("int").alias("_parts"))
    large = F.broadcast(large) if large.count() <= BROADCAST_DOCUMENTS else large
    rows, own = (df.join(large, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc").withColumn("_parts", F.coalesce("_parts", F.lit(1))) for df in (rows, own))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    rows = rows.select("doc_id", F.pmod(F.xxhash64("_text", "_row"), F.col("_parts")).cast("int").alias("_part"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_order"), "_text", F.lit(None).cast("string").alias("_payload"), "_row")
    own = own.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_kind"), "_order", "_text", "_payload", F.lit(None).cast(kinds["_row"]).alias("_row"))
    return rows.unionByName(own).repartition("doc_id", "_part").sortWithinPartitions("doc_id", "_part", "_kind", "_order", "_text")


def _pass(both: DataFrame, every: bool, find, names: Sequence[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """``find(matcher, text)`` gives tuples of the named columns for each text; its row comes before them as ``_row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entries, matcher = None, [], None
        for b in pieces(batches, 4):
            docs, parts, kinds, _, texts, payloads = (b.column(i).to_pylist() for i in range(6))
            at, out = [], []
            for i, own in enumerate(zip(docs, parts, strict=True)):
                if own != key:
                    key, entries, matcher = own, [], None
                if not kinds[i]:
                    entries.append((texts[i], payloads[i]))
                    continue
                matcher = matcher or Matcher(entries, every)
                found = find(matcher, texts[i])
                at += [i] * len(found)
                out += found
            for start, end in cut([len(texts[i] or "") for i in at]):  # each place has a copy of its row
                columns = zip(*out[start:end], strict=True)
                yield pa.RecordBatch.from_arrays([b.column(6).take(pa.array(at[start:end], pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, names, strict=True))], names=["_row", *(n for n, _ in names)])

    return both.mapInArrow(run, f"_row {both.schema['_row'].dataType.simpleString()}, {schema}")


def value_places(texts: DataFrame, values: DataFrame, text: str = "text", payload: Column | None = None, every: bool = False, alone: bool = False, keep: Sequence[str] | None = None, once: bool = False) -> DataFrame:
    """texts' columns (those of ``keep``, if it is there) with value, start, end and payload for each place of a document's own values (doc_id, value and, if
    there, seq). ``every``: a row for each value of a folded form; ``alone``: places of one value do not overlap;
    ``once``: of each value only the first place in a text."""
    find = (lambda m, t: [(v, s, e, p) for s, e, v, p in apart(m.find(t))]) if alone else (lambda m, t: [(v, s, e, p) for s, e, v, p in m.find(t)])
    if once:
        find = lambda m, t: [(v, s, e, p) for v, (s, e, p) in {v: (s, e, p) for s, e, v, p in reversed(m.find(t))}.items()]
    names = [("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("payload", pa.string())]
    out = _pass(_together(texts, values, text, payload, keep), every, find, names, "value string, start int, end int, payload string")
    return out.select("_row.*", "value", "start", "end", "payload")


def sweep(texts: DataFrame, values: DataFrame, text: str = "text", label: str = fixed.LABEL, to: str = "swept") -> DataFrame:
    """texts with one column more: all places of the document's own values (doc_id, value, replacement if there) replaced in
    one pass; values without a replacement become the label. Overlapping and touching places are one."""

    def find(matcher: Matcher, t: str | None) -> list[tuple]:
        at, out = 0, []
        for start, end, replacement in merged(matcher.find(t)):
            out += [t[at:start], label if replacement is None else replacement]
            at = end
        return [(t if not at else "".join(out) + t[at:],)]

    payload = F.col("replacement") if "replacement" in values.columns else None
    return _pass(_together(texts, values, text, payload), False, find, [(to, pa.string())], f"`{to}` string").select("_row.*", to)
