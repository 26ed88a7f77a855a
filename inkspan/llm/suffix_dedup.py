"""Removal of byte strings that also start earlier, by suffix order of depth ``LENGTH``.

Only suffixes that can have an equal are ordered. Every window of ``LENGTH`` bytes has an anchor: its leftmost least
hashed ``GRAM``; equal windows have equal anchors at equal places. Anchors are shuffled by hash (packed, a few bytes
each); those that occur once in the corpus settle their windows. For the others the bytes around the anchor go to the
owner of the hash, who orders them deep-shallow: multikey quicksort, ternary around a pivot word of eight bytes, down to
``SHALLOW`` words; the groups that still share this prefix go to blind tries, which descend by branching bytes only,
compare once with the leaf they reach, and give their leaves back in order. First the contexts are ordered, so that
copies of one context need no more work; then, where an anchor has several contexts, the suffixes that start in them.
Neighbours in the order that are equal have one rank; all but the earliest of a rank (smaller id, or same document and
earlier start) are covered by removed bytes. Hashes only ever choose what is compared.

A hash or context that a large share of all documents hold never meets in one task: a task that sees a hash again knows
that it is repeated and sends one of each chunk to the owner, the others anywhere; a task that sees a context again, later
than one it has sent, removes it on the spot. The number of partitions follows the bytes of text.

Documents equal to one of a smaller id as a whole are told by SHA-256 beforehand: all their bytes go (from ``LENGTH`` up).

Defined cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; a null id sorts first (the least long is
read as null); each row is a document of its own, and of rows that share an id only a smaller start is earlier, so strings
that start at one place of one id all stay; an empty table gives an empty result; extra columns do not pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, join_salted, lists, table, whole_text

LENGTH, GRAM = 100, 40
SPAN = LENGTH - GRAM  # an anchor starts at most so far after its window
#: Words of eight bytes that are sorted before the tries take over.
SHALLOW = 3
#: Bytes of text hashed at once; contexts whose suffixes are ordered at once.
BLOCK, CONTEXTS = 1 << 20, 20_000
WIDTH = LENGTH + SPAN  # of a context: SPAN bytes before the anchor, the anchor, SPAN bytes after it
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all grams of GRAM = 32 + 8 bytes."""
    h, step, kept = (b.astype(np.uint64) + np.uint64(1)) * _K[0], 1, None
    for k in _K[1:6]:
        h = h[:-step] * k + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
        if step == 8:
            kept = h
    h = h[: len(b) - GRAM + 1] * _K[6] + kept[32 : 32 + len(b) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= _K[0]
    return h ^ (h >> np.uint64(29))


def anchors(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, place, least, most) of the anchors of a text of LENGTH bytes or more: windows start from ``least`` to
    ``most`` bytes before the place."""
    h = gram_hashes(b)
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)  # leftmost of equal ones
    low, size = key, 1
    while size * 2 <= SPAN + 1:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(b) - LENGTH + 1
    low = np.minimum(low[:n], low[SPAN + 1 - size : SPAN + 1 - size + n])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], n] - 1
    place = at[first]
    return h[place], place, place - last, place - first


def document_anchors(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a whole text, block by block; blocks overlap so that every window lies in one."""
    for i in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
        b = np.frombuffer(text[i : i + BLOCK + LENGTH - 1], np.uint8)
        if len(b) >= LENGTH:
            h, place, lo, hi = anchors(b)
            yield h, place + i, lo, hi


class BlindTrie:
    """Strings of one length: inner nodes hold a depth and branch by the byte there; leaves hold a string and its items."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    def insert(self, s: bytes, item: int) -> None:
        if self.root is None:
            self.root = (s, [item])
            return
        node = self.root
        while type(node) is list:  # blind: bytes between branches are not looked at
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        leaf = node[0]
        if leaf == s:
            node[1].append(item)
            return
        n = len(s) - 1 - ((int.from_bytes(s) ^ int.from_bytes(leaf)).bit_length() - 1) // 8
        new = (s, [item])
        above, node = None, self.root
        while type(node) is list and node[0] < n:
            above, node = node, node[1][s[node[0]]]
        if type(node) is list and node[0] == n:
            node[1][s[n]] = new
        else:
            branch = [n, {leaf[n]: node, s[n]: new}]
            if above is None:
                self.root = branch
            else:
                above[1][s[above[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """The items of each distinct string, in the order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def multikey_quicksort(start: np.ndarray, group: np.ndarray, words: np.ndarray, offsets: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first, open): the strings in order of their group and of the words at the offsets; first marks where a new
    (group, words) begins; open: those of which there are several. All segments are split around their pivots (the median
    of three) at once: less and greater stay at their word, equal goes to the next."""
    n = len(start)
    item = np.argsort(group, kind="stable")
    first = np.r_[True, group[item][1:] != group[item][:-1]] if n else np.zeros(0, bool)
    depth = np.zeros(n, np.int8)  # by position, of its segment
    at = np.arange(n)  # positions of open segments
    last = len(offsets)
    place = np.array([*offsets, 0])
    while True:
        new = first[at]
        alone = new & np.r_[new[1:], True] if len(at) else new
        at = at[~alone & (depth[at] < last)]
        if not len(at):
            break
        new = np.flatnonzero(first[at])
        size = np.diff(np.r_[new, len(at)])
        own = np.repeat(np.arange(len(new)), size)
        w = words[start[item[at]] + place[depth[at]]]
        a, b, c = w[new], w[new + size // 2], w[new + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[own]
        less, same = w < pivot, w == pivot
        n_less, n_same = np.add.reduceat(less, new, dtype=np.int64), np.add.reduceat(same, new, dtype=np.int64)
        rank = np.empty(len(at), np.int64)
        for mask, before in ((less, new), (same, new + n_less), (~(less | same), new + n_less + n_same)):
            k = np.cumsum(mask)
            rank[mask] = (before[own] + k - 1 - (k[new] - mask[new])[own])[mask]
        moved = np.empty(len(at), np.int64)
        moved[rank] = item[at]
        item[at] = moved
        for edge in (new + n_less, new + n_less + n_same):
            inside = edge < new + size
            first[at[edge[inside]]] = True
        deeper = np.zeros(len(at), bool)
        deeper[rank[same]] = True
        depth[at] += deeper
    several = ~(first & np.r_[first[1:], True]) if n else first
    return item, first, several


def deep_shallow(start: np.ndarray, group: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings data[start : start + length] in the order of (group, bytes): equal strings of a group share
    theirs. data must have 8 bytes after the last string."""
    n = len(start)
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    item, first, several = multikey_quicksort(start, group, words, offsets[:SHALLOW])
    deep = np.flatnonzero(several)
    if len(deep):
        heads = deep[first[deep]]
        leader = np.repeat(item[heads], np.diff(np.r_[np.flatnonzero(first[deep]), len(deep)]))
        same = np.ones(len(deep), bool)
        for o in offsets[SHALLOW:]:
            same &= words[start[item[deep]] + o] == words[start[leader] + o]
        mixed = np.logical_and.reduceat(same, np.flatnonzero(first[deep]))  # else a trie of one leaf: in order as it is
        stops = np.r_[heads[1:], 0]
        stops[-1] = deep[-1] + 1
        raw = data.tobytes() if not mixed.all() else b""
        sizes = np.diff(np.r_[np.flatnonzero(first[deep]), len(deep)])
        for h, size in zip(heads[~mixed].tolist(), sizes[~mixed].tolist(), strict=True):
            trie = BlindTrie()
            own = item[h : h + size]
            for i, a in zip(own.tolist(), start[own].tolist(), strict=True):
                trie.insert(raw[a : a + length], i)
            at = h
            for leaf in trie.leaves():
                item[at : at + len(leaf)] = leaf
                first[at] = True
                at += len(leaf)
    out = np.empty(n, np.int64)
    out[item] = np.cumsum(first) - 1
    return out


def earlier(classes: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(again, order, first, ties): again is True for all that come after the first (by doc, place) of their class; the
    first and its equals are the ``ties`` entries of ``order`` from ``first`` on."""
    order = np.lexsort((place, doc, classes))
    c, d, p = classes[order], doc[order], place[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
    lead = np.repeat(first, np.diff(np.r_[first, len(c)]))
    after = (d != d[lead]) | (p != p[lead])
    again = np.zeros(len(classes), bool)
    again[order] = after
    return again, order, first, np.add.reduceat(~after, first, dtype=np.int64) if len(first) else first


def strings(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, context: np.ndarray) -> np.ndarray:
    """What stands for an anchor with its context: 16 bytes of hash and bounds, then the context within the bounds."""
    column = np.arange(WIDTH)
    data = np.zeros((len(h), 16 + WIDTH), np.uint8)
    data[:, 16:] = np.where((column >= (SPAN - hi)[:, None]) & (column < (WIDTH - lo)[:, None]), context, 0)
    data[:, :8] = h.view(np.uint8).reshape(len(h), 8)
    data[:, 8], data[:, 9] = lo, hi
    return data


def covered(h: np.ndarray, doc: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, context: np.ndarray, row: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, start, end) of bytes to remove, for all occurrences of some anchors. context: one row of WIDTH bytes each;
    row: which document it is, where ids (doc) are not enough."""
    n, row = len(h), doc if row is None else row
    data = np.append(strings(h, lo, hi, context).ravel(), np.zeros(8, np.uint8))
    start = np.arange(n) * (16 + WIDTH)
    again, order, first, ties = earlier(deep_shallow(start, np.zeros(n, np.int64), data, 16 + WIDTH), doc, place)
    rows, starts, ends = [row[again]], [(place - hi)[again]], [(place - lo + LENGTH)[again]]
    at_order, n_ties = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of a first: it stands for its ties
    at_order[order[first]], n_ties[order[first]] = first, ties
    # anchors with several contexts: their suffixes
    rest = order[first]
    rest = rest[np.argsort(h[rest], kind="stable")]
    edge = np.flatnonzero(np.r_[True, h[rest][1:] != h[rest][:-1]]) if len(rest) else np.zeros(0, np.int64)
    size = np.diff(np.r_[edge, len(rest)])
    many = np.repeat(size > 1, size)
    rest, number = rest[many], np.repeat(np.arange(len(size)), size)[many]
    at = 0
    while at < len(rest):
        stop = min(at + CONTEXTS, len(rest))
        if stop < len(rest):  # whole anchors; one of more contexts than that is done by single offsets below
            stop = int(np.searchsorted(number, number[stop]))
            stop = stop if stop > at else int(np.searchsorted(number, number[at], "right"))
        r, num = rest[at:stop], number[at:stop]
        for offsets in [None] if len(r) <= CONTEXTS else range(SPAN + 1):
            if offsets is None:
                times = hi[r] - lo[r] + 1
                who = np.repeat(np.arange(len(r)), times)
                back = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times) + lo[r][who]
            else:
                who = np.flatnonzero((lo[r] <= offsets) & (offsets <= hi[r]))
                back = np.full(len(who), offsets)
            own = r[who]
            begin = start[own] + 16 + SPAN - back
            dup = earlier(deep_shallow(begin, num[who] * (SPAN + 1) + back, data, LENGTH), doc[own], place[own])[0]
            own, back = own[dup], back[dup]
            times = n_ties[own]
            tied = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(at_order[own], times)
            rows.append(row[order[tied]])
            starts.append(np.repeat(place[own] - back, times))
            ends.append(np.repeat(place[own] - back, times) + LENGTH)
        at = stop
    return merge(np.concatenate(rows), np.concatenate(starts), np.concatenate(ends))


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of the spans of each document; spans that touch are one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    number = np.cumsum(np.r_[True, doc[1:] != doc[:-1]])
    far = np.maximum.accumulate(end + number * (1 << 40)) - number * (1 << 40)
    new = np.r_[True, (number[1:] != number[:-1]) | (start[1:] > far[:-1])]
    first = np.flatnonzero(new)
    return doc[first], start[first], far[np.r_[first[1:], len(doc)] - 1]


def _pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket with its items' columns as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    stops = np.r_[first, len(bucket)]
    cols = [pa.array(bucket[first].astype(np.int32))]
    for c in columns.values():
        c = c[order]
        cols.append(pa.array([c[a:b].tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names=["bucket", *columns])


def _unpack(batches: list[pa.RecordBatch], kinds: dict[str, str]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x.as_buffer().to_pybytes() if (x := v).is_valid else b"" for b in batches for v in b.column(b.schema.get_field_index(k))), t) for k, t in kinds.items()]


ANCHOR = {"h": "<u8", "row": "<i8", "place": "<i8", "lo": "u1", "hi": "u1", "known": "u1"}
#: An item without a context has its bytes removed; it goes to any owner.
CONTEXT = {"h": "<u8", "row": "<i8", "place": "<i8", "lo": "u1", "hi": "u1", "doc": "<i8", "context": "u1"}
#: Bytes of text for a partition, partitions at most, contexts that a task remembers.
PART, PARTS, SEEN = 1 << 25, 100_000, 100_000


def _spread(row: np.ndarray, place: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (row.astype(np.uint64) * _K[0] + place.astype(np.uint64)) * _K[1]
    return ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def seen_again(seen: dict[bytes, tuple[int, int]], keys: Iterator[bytes], doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which contexts come later than one with the same key that was met before (and is not marked itself)."""
    again = np.zeros(len(doc), bool)
    for i, (k, at) in enumerate(zip(keys, zip(doc.tolist(), place.tolist(), strict=True), strict=True)):
        before = seen.get(k)
        if before is None or at < before:
            if before is None and len(seen) >= SEEN:
                seen.clear()
            seen[k] = at
        elif at > before:
            again[i] = True
    return again


def _packed(kinds: dict[str, str]) -> str:
    return "bucket int, " + ", ".join(f"{k} binary" for k in kinds)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the removed spans, kept (binary)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(whole_text())), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(PARTS, size // PART))
    buckets = 2 * n
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    # each row has its own number; the same three columns wherever texts are joined: Spark then deals them out by number
    # once and reuses that
    texts = docs.select(F.monotonically_increasing_id().alias("row"), key.alias("key"), whole_text().alias("text")).repartition(n, "row")
    whole = texts.select("row", "key", F.coalesce(F.sha2("text", 256), F.lit("")).alias("sha"))  # never null: no filter gets below the deal
    first = whole.groupBy("sha").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("last > first")
    copies = join_salted(whole, first.select("sha", "first"), "sha", by="row").where("key > first").select("row", F.lit(True).alias("copy"))
    marked = texts.join(copies.hint("shuffle_hash"), "row", "left")
    single = marked.where("copy is null").select("row", "key", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 8 * BLOCK):
            parts = [(np.full(len(h), r), h, p, lo, hi) for r, t in zip(b.column(0).to_pylist(), b.column(2), strict=True) for h, p, lo, hi in document_anchors(t.as_buffer().to_pybytes())]
            if parts:
                row, h, place, lo, hi = map(np.concatenate, zip(*parts, strict=True))
                order = np.argsort(h, kind="stable")
                same = np.r_[False, h[order][1:] == h[order][:-1]]
                known, bucket = np.zeros(len(h), np.uint8), (h % np.uint64(buckets)).astype(np.int64)
                known[order] = same | np.r_[same[1:], False]
                other = order[same]  # one of each hash goes to the owner, who learns from it that the hash is repeated
                if len(other):  # the rest of the chunk's stay together, anywhere
                    bucket[other] = _spread(row[other[:1]], place[other[:1]], buckets)
                yield _pack(bucket, {"h": h, "row": row, "place": place, "lo": lo.astype(np.uint8), "hi": hi.astype(np.uint8), "known": known})

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, row, place, lo, hi, known = _unpack(list(batches), ANCHOR)
        order = np.argsort(h)
        s = h[order]
        same = np.r_[False, s[1:] == s[:-1]] if len(s) else np.zeros(0, bool)
        keep = order[same | np.r_[same[1:], False] | (known[order] > 0)] if len(s) else order
        packed = place[keep] << 16 | lo[keep].astype(np.int64) << 8 | hi[keep]
        for i in range(0, len(keep), 100_000):
            at = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(row[keep[at]]), pa.array(packed[at]), pa.array(h[keep[at]].view(np.int64))], names=["row", "at", "h"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        for b in chunks(batches, "text", 2 * BLOCK):
            parts = []
            for r, k, t, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                raw = np.frombuffer(t.as_buffer().to_pybytes(), np.uint8)
                rows = items.values
                at, h = rows.field("at").to_numpy(zero_copy_only=False), rows.field("h").to_numpy(zero_copy_only=False)
                place = at >> 16
                where = place[:, None] + np.arange(-SPAN, GRAM + SPAN)
                body = np.where((where >= 0) & (where < len(raw)), raw[np.clip(where, 0, len(raw) - 1)], 0).astype(np.uint8)
                parts.append((h.view(np.uint64), np.full(len(h), r), np.full(len(h), k), place, (at >> 8 & 255).astype(np.uint8), (at & 255).astype(np.uint8), body))
            h, row, doc, place, lo, hi, body = map(np.concatenate, zip(*parts, strict=True))
            if len(h):
                data = strings(h, lo.astype(np.int64), hi.astype(np.int64), body)
                again = seen_again(seen, (x.tobytes() for x in data), doc, place)
                cols = {"h": h, "row": row, "place": place, "lo": lo, "hi": hi, "doc": doc, "context": body}
                yield _pack((h[~again] % np.uint64(buckets)).astype(np.int64), {k: v[~again] for k, v in cols.items()})
                if again.any():
                    yield _pack(np.repeat(_spread(row[:1], place[:1], buckets), int(again.sum())), {k: v[again] if k != "context" else body[again][:, :0] for k, v in cols.items()})

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        number = np.concatenate([b.column(0).to_numpy() for b in held]) if held else np.zeros(0, np.int32)
        one = pa.Table.from_batches(held) if held else None
        for k in np.unique(number):
            own = one.take(np.flatnonzero(number == k)).to_batches()
            sure = np.array([n == 0 for b in own for n in pc.binary_length(b.column(b.num_columns - 1)).to_pylist()], bool)
            parts = []
            for batch, kind in ((pa.Table.from_batches(own).filter(pa.array(m)), m is sure) for m in (sure, ~sure)):
                h, row, place, lo, hi, doc, body = _unpack(batch.to_batches(), CONTEXT)
                lo, hi = lo.astype(np.int64), hi.astype(np.int64)
                parts.append((row, place - hi, place - lo + LENGTH) if kind else covered(h, doc, place, lo, hi, body.reshape(len(h), WIDTH), row))
            r, s, e = merge(*map(np.concatenate, zip(*parts, strict=True)))
            for i in range(0, len(r), 100_000):
                at = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(r[at]), pa.array(s[at]), pa.array(e[at])], names=["row", "start", "end"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 4 * BLOCK):
            starts, stops, sizes, kept = [], [], [], []
            for t, copy, items in zip(b.column(2), b.column(3).to_pylist(), b.column(4), strict=True):
                raw = t.as_buffer().to_pybytes()
                s = e = np.zeros(0, np.int64)
                if copy and len(raw) >= LENGTH:
                    s, e = np.zeros(1, np.int64), np.full(1, len(raw))
                elif items.is_valid:
                    s, e = items.values.field("start").to_numpy(zero_copy_only=False), items.values.field("end").to_numpy(zero_copy_only=False)
                    _, s, e = merge(np.zeros(len(s), np.int64), s, e)
                edges = [0, *(x for pair in zip(s.tolist(), e.tolist(), strict=True) for x in pair), len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                starts.append(s)
                stops.append(e)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(sizes, pa.int64()), lists(starts, pa.int64()), lists(stops, pa.int64()), pa.array(kept, pa.binary())], names=["key", "n_bytes", "starts", "ends", "kept"])

    found = single.mapInArrow(find, _packed(ANCHOR)).repartition(n, "bucket").mapInArrow(repeated, "row long, at long, h long")
    found = found.groupBy("row").agg(F.collect_list(F.struct("at", "h")).alias("items"))
    around = single.join(found.hint("shuffle_hash"), "row").select("row", "key", "text", "items").mapInArrow(contexts, _packed(CONTEXT))
    spans = around.repartition(n, "bucket").mapInArrow(order, "row long, start long, end long")
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("items"))
    rows = marked.join(spans.hint("shuffle_hash"), "row", "left").select("row", "key", "text", "copy", "items")
    rows = rows.mapInArrow(cut, "key long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    return rows.select(F.when(F.col("key") != -(1 << 63), F.col("key")).alias("doc_id"), "n_bytes", "starts", "ends", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return rows.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """What the query returns, by a set of all strings seen so far; for tests on small tables."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out
