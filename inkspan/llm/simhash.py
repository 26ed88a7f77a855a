"""SimHash near-duplicates through BK-trees.

Fingerprints are made from word shingles and reduced to distinct values, one or more words of 64 bits each. Values meet
in shards: by tables of bit positions, a value goes to one shard for each table, named by its bits there. For 64 bits and
a small radius the tables are exact: of m blocks, two values within the radius agree on m - radius at least, and there is
a table for each choice of so many blocks; m grows with the number of values, so that a shard does not. For wide values
(near copies by similarity) positions are drawn, and as many tables as find a pair at the threshold with ``FOUND``.

A shard's distinct values form a BK-tree (children keyed by their integer Hamming distance to the parent); its queries
descend only along edges within the radius of their own distance. What a pivot links already needs no search of its own:
only values outside of a shard's largest component are queries, so that a group of thousands of near copies is not
compared pair by pair. Shards of more than ``SHARD`` values are split: each part is a tree of bounded size, and the
values that the shard's pivot does not reach are streamed past every part. A task emits a spanning forest of the links
that it finds, never all pairs; connected components then give the groups. Trees are built by whoever owns the shard
rather than sent to every machine, since what all of them would hold grows with the corpus.

Near copies by similarity are decided by the exact Jaccard similarity of sets of shingles; their fingerprints, of sets too,
find the candidates (``similar_groups``).

Defined cases: null texts are empty; texts without words have fingerprint 0 and link like any other (as near copies they
are one class); texts are never cut; a null id never names a group unless all its ids are null; repeated rows share
their group; an empty table gives an empty result; extra columns do not pass, but all pass ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, join_salted, lists, materialize, table, whole_text

WORDS, RADIUS, SEED = 3, 3, 42
#: Near copies by similarity: shingles of five words, eight words of 64 bits. Texts of Jaccard similarity 0.8 and equal
#: length differ in 78 of 512 bits on average, with a deviation of 8; the radius adds one deviation.
NEAR_WORDS, PARTS, SIMILARITY, NEAR_RADIUS = 5, 8, 0.8, 86
#: How likely a pair at the threshold is to meet in a shard.
FOUND = 0.97
#: Values of one BK-tree at most, about; and (query, node) pairs that a search holds at once, by words of a value.
SHARD, FRONTIER = 20_000, 1 << 20
#: Split shards whose pivots are broadcast at most; more are joined by a shuffle.
BROADCAST_SHARDS = 65_536
#: Rows gathered before a forest of small trees is searched.
BUFFER = 1 << 16
_MIX = np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each row of a matrix, (k, n) to (k, 64): three columns at a time are added
    to a sum and a carry of double weight, until few are left."""
    out, todo = np.zeros((len(h), 64), np.int64), [(h, 1)]
    while todo:
        a, weight = todo.pop()
        m = a.shape[1] // 3
        if m < 24:
            bits = np.unpackbits(np.ascontiguousarray(a).view(np.uint8), axis=1, bitorder="little")
            out += weight * bits.reshape(len(h), -1, 64).sum(axis=1, dtype=np.int64)
            continue
        x, y, z = a[:, :m], a[:, m : 2 * m], a[:, 2 * m : 3 * m]
        xy = x ^ y
        todo += [(xy ^ z, weight), ((x & y) | (xy & z), 2 * weight)]
        if a.shape[1] > 3 * m:
            todo.append((a[:, 3 * m :], weight))
    return out


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, in order and in pieces; bytes: A-Z only, split at 0x20 and 0x09-0x0D."""
    from xxhash import xxh64_intdigest

    own = text.encode().lower().split()
    n = max(1, len(own) - words + 1) if own else 0
    for i in range(0, n, 8192):
        part = own[i : i + 8192 + words - 1]
        shingles = map(b" ".join, zip(*(part[j:] for j in range(words)), strict=False)) if len(own) >= words else [b" ".join(own)]
        yield np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def majority(pieces: Iterator[np.ndarray], parts: int = 1) -> np.ndarray:
    """``parts`` words of 64 bits; a bit is set if it is set in over half of the hashes (further words: of hashes made from
    them). No hashes: zero."""
    ones, n = np.zeros((parts, 64), np.int64), 0
    for h in pieces:
        n += len(h)
        h = h[None]
        if parts > 1:
            h = np.concatenate([h, (h ^ (h >> np.uint64(31))) * _MIX[1:parts, None]])
            h[1:] ^= h[1:] >> np.uint64(29)
            h[1:] *= _MIX[0]
            h[1:] ^= h[1:] >> np.uint64(32)
        ones += bit_counts(h)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64)[:, 0] if n else np.zeros(parts, np.uint64)


def simhash(text: str, words: int = WORDS, parts: int = 1) -> np.ndarray:
    """The majority of the text's shingles, repeats included."""
    return majority(shingle_hashes(text, words), parts)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct hashes, in order of size."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def signatures(docs: DataFrame, words: int = NEAR_WORDS, parts: int = PARTS) -> DataFrame:
    """doc_id, mark (XXH64 of the text), fp (of the set of shingles), s1, s2 (128 bits of that set), size (of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, sums = [], []
            for t in b.column(2):
                h = shingle_set(t.as_py(), words)
                fp.append(majority((h[i : i + 8192] for i in range(0, len(h), 8192)), parts).view(np.int64))
                mixed = (h ^ (h >> np.uint64(29))) * _MIX[0]
                sums.append((h.sum(dtype=np.uint64), (mixed ^ (mixed >> np.uint64(32))).sum(dtype=np.uint64), len(h)))
            s1, s2, n = (np.array(x, np.uint64).view(np.int64) for x in zip(*sums, strict=True)) if sums else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(fp, pa.int64()), *map(pa.array, (s1, s2, n))], names=["doc_id", "mark", "fp", "s1", "s2", "size"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(whole_text()).alias("mark"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, fp array<long>, s1 long, s2 long, size long")


def fingerprints(docs: DataFrame, words: int = WORDS, parts: int = 1) -> DataFrame:
    """doc_id, fp (the words of 64 bits as signed longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [simhash(t.as_py(), words, parts).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), lists(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, fp array<long>")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the rows of two matrices of words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class BKForest:
    """BK-trees over groups of distinct values, in flat arrays; built and searched a level at a time."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        """values: a row of words each; group: non-decreasing; the first value of each group is its root."""
        self.values, self.base = values, 64 * values.shape[1] + 1
        n = len(values)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.group, self.starts = group[starts], starts
        keys, kids = [], []
        lone = np.ones(n, bool)
        lone[starts] = False
        item = np.flatnonzero(lone)
        at = np.repeat(starts, np.diff(np.r_[starts, n]))[item]
        while len(item):
            key = at * self.base + distance(values[item], values[at])
            uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            keys.append(uniq)
            kids.append(item[first])
            at = item[first][inverse]
            rest = np.ones(len(item), bool)
            rest[first] = False
            item, at = item[rest], at[rest]
        self.keys, self.kids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, kids))
        order = np.argsort(self.keys)
        self.keys, self.kids = self.keys[order], self.kids[order]

    def root(self, group: np.ndarray) -> np.ndarray:
        return self.starts[np.searchsorted(self.group, group)]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, node) arrays of all nodes within the radius, in bounded pieces."""
        most = FRONTIER // self.values.shape[1]
        stack = [(np.arange(len(queries)), roots)]
        while stack:
            q, at = stack.pop()
            if len(q) > most:
                half = len(q) // 2
                stack += [(q[:half], at[:half]), (q[half:], at[half:])]
                continue
            d = distance(queries[q], self.values[at])
            if (hit := d <= radius).any():
                yield q[hit], at[hit]
            lo = np.searchsorted(self.keys, at * self.base + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, at * self.base + np.minimum(d + radius, self.base - 1), "right") - lo
            for some in np.array_split(np.arange(len(q)), max(1, int(n.sum()) // most + 1)) if n.any() else []:
                m = n[some]
                if total := int(m.sum()):
                    stack.append((np.repeat(q[some], m), self.kids[np.repeat(lo[some] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(total)]))


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components (labels are the least index) of all pairs."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label] != label).any():
            label[up] = label[label[up]]


def forest_links(member: np.ndarray, member_group: np.ndarray, query: np.ndarray, query_group: np.ndarray, radius: int, done: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the members of each group and between queries and members: indices into both,
    members first, and of their components' first. Groups are non-decreasing; a query with a group of no members is left.
    done: members whose links to one another are known from before."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tree = BKForest(member, member_group)
    held = np.flatnonzero(np.isin(query_group, member_group))  # a part may hold no value of its own
    label, every = np.arange(n + len(query)), np.arange(n)
    start = np.repeat(tree.starts, np.diff(np.r_[tree.starts, n]))
    # pivots: what one links at once needs no search of its own
    tried = np.zeros(n, bool)
    for _ in range(3):
        free = np.flatnonzero((label[:n] == every) & ~tried)
        pivot = np.full(n, n)
        np.minimum.at(pivot, start[free], free)
        tried[pivot[pivot < n]] = True
        pivot = pivot[start]
        some = np.flatnonzero((pivot < n) & (pivot != every))
        some = some[distance(member[some], member[pivot[some]]) <= radius]
        _union(label, some, pivot[some])
    size = np.bincount(label[:n], minlength=n)
    largest, top = np.zeros(n, np.int64), np.full(n, n)
    np.maximum.at(largest, start, size[label[:n]])
    heads = np.flatnonzero((size > 0) & (size == largest[start]))
    np.minimum.at(top, start[heads], heads)
    own = np.flatnonzero((label[:n] != top[start]) & (True if done is None else ~done))
    index = np.r_[own, n + held]
    values, groups = np.concatenate([member[own], query[held]]), np.r_[member_group[own], query_group[held]]
    for q, at in tree.search(values, tree.root(groups), radius):
        _union(label, index[q], at)
    far = np.flatnonzero(label != np.arange(len(label)))
    return far, label[far]


def forest_pairs(member: np.ndarray, member_group: np.ndarray, member_class: np.ndarray, query: np.ndarray, query_group: np.ndarray, query_class: np.ndarray, radius: int, every: bool, done: np.ndarray | None = None, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius, as indices into members and queries, between rows of different classes. ``every``: all of
    them; else as many as connect what all of them connect. ``keep(a, b)``: which of the pairs to give; they are sorted out as
    they are found, so that what is held follows what is given."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tree = BKForest(member, member_group)
    held = np.flatnonzero(np.isin(query_group, member_group))
    _, label = np.unique(np.r_[member_class, query_class[held]], return_inverse=True)
    # a label is the least index of its class within the group
    group = np.r_[member_group, query_group[held]]
    _, first, label = np.unique(np.stack([group, label], 1), axis=0, return_index=True, return_inverse=True)
    label = first[label.ravel()]
    values, start = np.concatenate([member, query[held]]), np.repeat(tree.starts, np.diff(np.r_[tree.starts, n]))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    back = np.r_[np.arange(n), n + held]

    def take(a: np.ndarray, b: np.ndarray) -> None:
        x, y = label[a], label[b]
        new = x != y
        if not every:
            _, first_ = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0, return_index=True)
            new &= np.isin(np.arange(len(a)), first_)
        if new.any():
            a, b = a[new], b[new]
            if not every:
                _union(label, a, b)
            given = slice(None) if keep is None else keep(back[a], back[b])
            out.append((a[given], b[given]))

    if not every:  # what a pivot reaches is compared with it alone
        tried = np.zeros(n, bool)
        for _ in range(3):
            free = np.flatnonzero((label[:n] == np.arange(n)) & ~tried)
            pivot = np.full(n, n)
            np.minimum.at(pivot, start[free], free)
            tried[pivot[pivot < n]] = True
            pivot = pivot[start]
            some = np.flatnonzero((pivot < n) & (pivot != np.arange(n)))
            some = some[distance(member[some], member[pivot[some]]) <= radius]
            take(some, pivot[some])
    size = np.bincount(label[:n], minlength=n + len(held))[: n + len(held)]
    largest, top = np.zeros(n, np.int64), np.full(n, n + len(held))
    np.maximum.at(largest, start, size[label[:n]])
    heads = np.flatnonzero(size[label[:n]] == largest[start])
    np.minimum.at(top, start[heads], label[heads])
    own = np.flatnonzero((label[:n] != top[start]) & (True if done is None else ~done))
    index = np.r_[own, n + np.arange(len(held))]
    for q, at in tree.search(values[index], tree.root(np.r_[member_group[own], query_group[held]]), radius):
        take(index[q], at)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return back[a], back[b]


def exact_tables(n: int, radius: int = RADIUS, most: int = SHARD // 8) -> list[list[int]]:
    """Tables for 64 bits: all choices of m - radius of m blocks, with the least m that leaves about ``most`` of n random
    values in a shard."""
    for m in range(radius + 1, 17):
        bits = (64 // m) * (m - radius)
        if n <= most << bits:
            break
    blocks = [list(range(i * 64 // m, (i + 1) * 64 // m)) for i in range(m)]
    return [sum((blocks[i] for i in some), []) for some in combinations(range(m), m - radius)]


def drawn_tables(n: int, bits: int = 64 * PARTS, similarity: float = SIMILARITY, found: float = FOUND) -> list[list[int]]:
    """Tables for wide values: positions drawn by a fixed seed, more of them the more values there are, and so many tables
    that a pair whose texts have the Jaccard similarity meets in one of them with the probability ``found``."""
    width = max(16, math.ceil(math.log2(max(n, 2))) - 2)
    agree = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** width
    rng = np.random.Generator(np.random.PCG64([SEED, width]))
    return [rng.choice(bits, width, replace=False).tolist() for _ in range(math.ceil(math.log(1 - found) / math.log(1 - agree)))]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def routes(values: np.ndarray, tables: Sequence[Sequence[int]]) -> np.ndarray:
    """(values, tables): a name for the bits of each value at the positions of each table."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8), axis=1, bitorder="little")
    out = np.zeros((len(values), len(tables)), np.uint64)
    for k, positions in enumerate(tables):
        own = np.packbits(bits[:, positions], axis=1, bitorder="little")
        own = np.pad(own, ((0, 0), (0, 8 - own.shape[1]))) if own.shape[1] < 8 else own
        step = np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        out[:, k] = (np.ascontiguousarray(own).view(np.uint64)[:, 0] + step) * np.uint64(0xD6E8FEB86659FD93)
    return out.view(np.int64)


def _shards(values: DataFrame, radius: int, tables: Sequence[Sequence[int]], shard: int, every: bool = False) -> DataFrame:
    """(route, part, query, node, class, fp), the rows of a shard's part together, members before queries. ``every``: all
    values are shown to all parts of a split shard, also those that its pivot reaches."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                own = b.slice(i, 4096)
                yield pa.RecordBatch.from_arrays([*own.columns, lists(list(routes(_matrix(own.column(2)), tables)), pa.int64())], names=["node", "class", "fp", "routes"])

    routed = values.select("node", "class", "fp").mapInArrow(name, "node long, class long, fp array<long>, routes array<long>").select("node", "class", "fp", F.explode("routes").alias("route"))
    big = routed.groupBy("route").agg(F.count("*").alias("n"), F.min("fp").alias("pivot")).where(F.col("n") > shard)
    big = materialize(big.select("route", F.ceil(F.col("n") / shard).cast("int").alias("parts"), "pivot"), "shards")
    big = F.broadcast(big) if big.count() <= BROADCAST_SHARDS else big
    rows = routed.join(big, "route", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    apart = F.expr("aggregate(zip_with(fp, pivot, (x, y) -> bit_count(x ^ y)), 0, (s, d) -> s + d)")
    # what the shard's pivot reaches is linked through it and stays in its own part; the pivot is known to every part
    shown = (F.col("parts") > 1) if every else (F.col("parts") > 1) & ((apart > radius) | (apart == 0))
    at = F.when(shown, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    rows = rows.withColumn("own", own).withColumn("part", F.explode(at)).withColumn("query", (F.col("part") != F.col("own")).cast("int"))
    return rows.select("route", "part", "query", "node", "class", "fp").repartition("route", "part").sortWithinPartitions("route", "part", "query", "fp")


def first_shared(x: np.ndarray, y: np.ndarray, tables: Sequence[Sequence[int]]) -> np.ndarray:
    """For pairs of values the name of the first shard that both go to."""
    out = np.zeros(len(x), np.int64)
    for i in range(0, len(x), 4096):
        a, b = routes(x[i : i + 4096], tables), routes(y[i : i + 4096], tables)
        out[i : i + 4096] = a[np.arange(len(a)), (a == b).argmax(axis=1)]
    return out


def _searched(rows: DataFrame, search, tables: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """(a, b): what ``search`` finds in each part, given members' and queries' values, groups, classes and whether members
    have been searched before. tables: a pair counts in the first shard that both values go to, which connects them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(route, part, query, node, kind, fp, done) -> pa.RecordBatch:
            group = np.cumsum(np.r_[False, (route[1:] != route[:-1]) | (part[1:] != part[:-1])])
            m = query == 0
            names = np.r_[node[m], node[~m]]
            values, at = np.concatenate([fp[m], fp[~m]]), np.r_[route[m], route[~m]]
            keep = None if tables is None else lambda a, b: first_shared(values[a], values[b], tables) == at[a]
            a, b = search(fp[m], group[m], kind[m], fp[~m], group[~m], kind[~m], done[m], keep)
            return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []

        def gathered() -> tuple[np.ndarray, ...]:
            return tuple(map(np.concatenate, zip(*held, strict=True)))

        for b in batches:
            route, part, query, node, kind = (b.column(i).to_numpy() for i in range(5))
            held.append((route, part, query, node, kind, _matrix(b.column(5)), np.zeros(len(route), bool)))
            if sum(len(x[0]) for x in held) < BUFFER:
                continue
            now = gathered()
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])  # this part may go on
            if not last.all():
                yield solve(*(x[~last] for x in now))
            tail = tuple(x[last] for x in now)
            if tail[2][-1]:  # its members are all here: search what has come, hold the members
                yield solve(*tail)
                own = tail[2] == 0
                tail = (*(x[own] for x in tail[:6]), np.ones(int(own.sum()), bool))
            held = [tail] if len(tail[0]) else []
        if held:
            yield solve(*gathered())

    return rows.mapInArrow(run, "a long, b long")


def links(values: DataFrame, radius: int, tables: Sequence[Sequence[int]], shard: int = SHARD) -> DataFrame:
    """(a, b): links that connect all distinct values (node long, fp array of longs) that lie within the radius and share
    the bits of a table; not all pairs."""
    rows = _shards(values.withColumn("class", F.lit(0).cast("long")), radius, tables, shard)
    return _searched(rows, lambda m, mg, _, q, qg, __, done, ___: forest_links(m, mg, q, qg, radius, done))


def pairs_within(values: DataFrame, radius: int, tables: Sequence[Sequence[int]], shard: int = SHARD, every: bool = False) -> DataFrame:
    """(a, b), a < b: pairs of values (node, class, fp) of different classes within the radius that share a table's bits:
    all, or as many as connect the same."""
    rows = _shards(values, radius, tables, shard, every)
    found = _searched(rows, lambda m, mg, mc, q, qg, qc, done, keep: forest_pairs(m, mg, mc, q, qg, qc, radius, every, done, keep), tables)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _groups(own: DataFrame, radius: int, tables, shard: int) -> DataFrame:
    """doc_id, fp, component_id for documents (doc_id, fp) with the tables for a number of values."""
    values = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "values")
    nodes = components(links(values, radius, tables(values.count()), shard))
    named = nodes.join(values.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    reach = nodes.join(named, "component").select("node", "component_id")
    # a table: the join of all documents below can then be split where one value has very many
    classes = materialize(values.join(reach, "node", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "classes")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """doc_id, fp (64 bits), component_id: the smallest id of the documents that links reach; no link is missed."""
    own = materialize(fingerprints(docs, words), "simhash")
    return _groups(own, radius, lambda n: exact_tables(n, radius), shard)


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """pairs with ok: whether the sets of shingles have that Jaccard similarity, exactly. Sets are made for the documents of
    the pairs only; pairs whose sizes rule it out need none."""
    pairs = materialize(pairs, "pairs")
    size = nodes.select("node", "size")
    both = pairs.join(size.withColumnsRenamed({"node": "a", "size": "na"}), "a").join(size.withColumnsRenamed({"node": "b", "size": "nb"}), "b")
    both = materialize(both.withColumn("near", F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9), "sized")
    near = both.where("near").select("a", "b")
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(ends, "node").select("node", "doc_id", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), lists([shingle_set(t.as_py(), words).view(np.int64) for t in b.column(1)], pa.int64())], names=["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text()).alias("_mark"), whole_text().alias("text"))
    texts = texts.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark"))).dropDuplicates(["node"])
    sets = materialize(texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>"), "sets")
    left = join_salted(near, sets.withColumnsRenamed({"node": "a", "shingles": "_sa"}), "a", by="b")  # a hub has very many partners
    same = F.size(F.array_intersect("_sa", "_sb"))
    checked = join_salted(left, sets.withColumnsRenamed({"node": "b", "shingles": "_sb"}), "b", by="a").withColumn("_same", same)
    ok = F.col("_same") >= (F.size("_sa") + F.size("_sb") - F.col("_same")) * similarity - 1e-9
    return materialize(checked.select("a", "b", ok.alias("ok")).unionByName(both.where("not near").select("a", "b", F.lit(False).alias("ok"))), "checked")


def similar_groups(docs: DataFrame, words: int = NEAR_WORDS, radius: int = NEAR_RADIUS, parts: int = PARTS, similarity: float = SIMILARITY, shard: int = SHARD) -> DataFrame:
    """doc_id, mark, component_id, component_mark: near copies by similarity of their sets of shingles. Fingerprints find
    candidates, exact Jaccard similarity decides, and only what it confirms links.

    First as many candidates are checked as connect all that lie within the radius. Where one fails, the groups that it was
    to join may still have a link elsewhere: all pairs between such groups are then checked too. A class of equal sets is one
    node. The component's document is the one with the smallest id (and mark), a null id last."""
    own = materialize(signatures(docs, words, parts), "signatures")
    best = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "mark")
    nodes = own.groupBy("s1", "s2").agg(F.min("fp").alias("fp"), F.min(best).alias("best"), F.max("size").alias("size"))
    nodes = materialize(nodes.select("s1", "s2", "fp", "size", F.col("best.doc_id").alias("doc_id"), F.col("best.mark").alias("mark"), F.monotonically_increasing_id().alias("node")), "nodes")
    # sets of one fingerprint meet its first set only; if that fails, they are searched like any others
    values = materialize(nodes.groupBy("fp").agg(F.min("node").alias("node")).withColumn("class", F.col("node")), "values")
    alike = nodes.select("fp", F.col("node").alias("b")).join(values.select("fp", F.col("node").alias("a")), "fp").where("a != b").select("a", "b")
    tables = drawn_tables(values.count(), 64 * parts, similarity)
    checked = confirmed(pairs_within(values, radius, tables, shard).unionByName(alike), nodes, docs, words, similarity)
    good = checked.where("ok").select("a", "b")
    reach = components(good)
    failed = checked.where("not ok")
    if not failed.isEmpty():
        label = materialize(nodes.select("node", "fp").join(reach, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("class")), "classes")
        met = failed.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node").select("class").distinct()
        open_ = materialize(label.join(met, "class"), "open")
        tables = drawn_tables(open_.count(), 64 * parts, similarity)
        rest = pairs_within(open_, radius, tables, shard, every=True).join(checked.select("a", "b"), ["a", "b"], "left_anti")
        more = confirmed(rest, nodes, docs, words, similarity).where("ok").select("a", "b")
        reach = components(good.unionByName(more))
    named = reach.join(nodes.select("node", best.alias("best")), "node").groupBy("component").agg(F.min("best").alias("first"))
    classes = reach.join(named, "component").select("node", "first")
    classes = nodes.join(classes, "node", "left").select("s1", "s2", F.coalesce("first", best).alias("first"))
    return own.join(materialize(classes, "classes"), ["s1", "s2"]).select("doc_id", "mark", F.col("first.doc_id").alias("component_id"), F.col("first.mark").alias("component_mark"))


def keep_one(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The documents, all columns, that name their group: one of each group of near copies (five-word shingles, exact
    similarity of 0.8, unless groups are given); rows repeated with id and text stay once."""
    groups = similar_groups(docs) if groups is None else groups
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("component_mark"))).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_of")).distinct()
    key = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit(""))
    rows = docs.withColumns({"_key": key(F.col("doc_id")), "_mark": F.xxhash64(whole_text())})
    kept = kept.select(key(F.col("_id")).alias("_key"), F.col("_of").alias("_mark"))
    return rows.join(kept, ["_key", "_mark"], "left_semi").dropDuplicates(["_key", "_mark"]).drop("_key", "_mark")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", hex_of(F.col("fp")[0]).alias("fingerprint"), "component_id")
