"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are cut only where they exceed a sequence. Full pieces are sequences of their own; the others are dealt at
random into shards of about ``SHARD`` pieces, so that memory and time of a task do not follow the corpus. For each shard
several islands evolve: a chromosome is a grouping of the shard's pieces into sequences; crossover injects whole
well-filled sequences of the mate, drops the sequences that hold copies of the injected pieces, and best-fits the
displaced pieces. Between rounds each island's elite also moves to the next island. The shard's best grouping wins: the
one of fewer sequences; of equally many, the one whose fill is spread furthest, so that what is free gathers in few
sequences. Every round has all its offspring, also where the seeds already meet the bound of tokens / capacity.

Defined cases: a null text has the end id only; repeated rows are packed as often as they occur; a null id passes;
pieces of equal length are interchangeable and ordered by their row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialize, table, whole_text

CAPACITY, END = 2048, 0
#: Pieces of a shard, islands of a shard, rounds with migration between them, chromosomes of an island, offspring a round.
SHARD, ISLANDS, ROUNDS, POPULATION, OFFSPRING = 16_384, 2, 2, 4, 12
#: Memoised words per Python worker, and characters of one at most: some 150 MB in all. The memo starts afresh when full.
MEMO, MEMO_CHARS = 500_000, 64
#: A word of letters whose lower case and composition do not depend on what is around them, with a stop or comma.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")
#: White space other than 0x09-0x0D and 0x20: libraries differ on it, so such texts are encoded in one call.
RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")


class WordTokenizer:
    """Ids as little-endian uint32 bytes; words between white space are memoised where the tokenizer drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        spec = self.tk.to_str()
        self.by_word = '{"type":"Replace","pattern":{"Regex":"\\\\s+"},"content":" "}' in spec and '[^\\\\s\\\\p{L}\\\\p{N}]+"},"behavior":"Removed","invert":true}' in spec
        self.memo: dict[str, bytes] = {}
        self.core: dict[str, bytes] = {}  # by lower-case letters alone
        # a byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.alphabet = {c: chr(i) for c, i in ((c, c if c in set(own) else next(rest)) for c in range(256))}
        self.stops = {"": b""} | {x: self.library(x) for x in ".,"}

    def library(self, text: str) -> bytes:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, letters: str) -> bytes:
        """Ids of one lower-case word of Latin-1 letters, from the tokenizer's merges alone."""
        ids = self.core.get(letters)
        if ids is None:
            if len(self.core) >= MEMO:
                self.core.clear()
            word = "".join(map(self.alphabet.__getitem__, letters.encode()))
            ids = np.array([t.id for t in self.tk.model.tokenize(word)], "<u4").tobytes()
            if len(letters) <= MEMO_CHARS:
                self.core[letters] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.by_word or (not text.isascii() or not text.isprintable()) and RARE_SPACE.search(text):
            return self.library(text)
        words = text.split()
        memo = self.memo
        got = list(map(memo.get, words))
        if None in got:
            odd, fresh = [], {}
            for w in {w for w, g in zip(words, got, strict=True) if g is None}:
                if m := PLAIN.fullmatch(w):
                    fresh[w] = self.plain(m[1].lower()) + self.stops[m[2]]
                else:
                    odd.append(w)
            for w, e in zip(odd, self.tk.encode_batch(odd, add_special_tokens=False), strict=True):
                fresh[w] = np.array(e.ids, "<u4").tobytes()
            got = [fresh[w] if g is None else g for w, g in zip(words, got, strict=True)]
            if len(memo) + len(fresh) > MEMO:
                memo.clear()
            memo.update((w, ids) for w, ids in islice(fresh.items(), MEMO) if len(w) <= MEMO_CHARS)
        return b"".join(got)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if kept, ids (little-endian uint32) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk, end = tokenizer(path), np.array([END], "<u4").tobytes()
        for b in chunks(batches, "text"):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = tk(text) + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, p, at // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[i], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if keep_ids:
                arrays.append(pa.array(cols[5], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, items: np.ndarray, bin_of: np.ndarray, free: list[int], capacity: int) -> None:
    """Put the items, in their order, into the bins they fit best; changes bin_of and free (space left, -1: no bin)."""
    spots: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(free):
        if f > 0:
            spots[f].append(b)
            mask |= 1 << f
    for i, n in zip(items.tolist(), lengths[items].tolist(), strict=True):
        m = mask >> n
        if m:
            f = n + (m & -m).bit_length() - 1
            b = spots[f].pop()
            if not spots[f]:
                mask ^= 1 << f
        else:
            f, b = capacity, len(free)
            free.append(capacity)
        f -= n
        free[b] = f
        if f:
            spots[f].append(b)
            mask |= 1 << f
        bin_of[i] = b


def compact(bin_of: np.ndarray) -> np.ndarray:
    return np.unique(bin_of, return_inverse=True)[1].astype(np.int32)


def fitness(lengths: np.ndarray, bin_of: np.ndarray, capacity: int) -> tuple[int, float]:
    """(sequences, -mean squared fill): less is better."""
    fill = np.bincount(bin_of, weights=lengths) / capacity
    return len(fill), -float((fill**2).mean()) if len(fill) else 0.0


def first_fits(lengths: np.ndarray, rng: np.random.Generator, capacity: int, jitter: float) -> np.ndarray:
    """A chromosome by best fit in order of (jittered) decreasing length."""
    order = np.argsort(-lengths * (1 + jitter * rng.random(len(lengths))), kind="stable")
    bin_of = np.zeros(len(lengths), np.int32)
    best_fit(lengths, order, bin_of, [], capacity)
    return compact(bin_of)


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """A child of a with whole well-filled bins of b, and the displaced items best-fitted anew."""
    fill_b = np.bincount(b, weights=lengths)
    good = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.5))
    chosen = np.zeros(len(fill_b), bool)
    chosen[rng.permutation(good)[: max(1, int(len(good) * rng.uniform(0.1, 0.5)))]] = True
    injected = chosen[b]
    n_a = int(a.max()) + 1
    hit = np.zeros(n_a, bool)
    hit[a[injected]] = True
    poor = np.argsort(np.bincount(a, weights=lengths))[: 1 + n_a // 50]  # the worst bins are opened as well
    hit[poor] = True
    child = np.where(injected, b + n_a, a).astype(np.int32)
    out = hit[a] & ~injected
    child[out] = -1
    free = np.full(n_a + len(fill_b), -1, np.int64)
    used = np.bincount(child[~out], weights=lengths[~out], minlength=len(free)).astype(np.int64)
    free[used > 0] = capacity - used[used > 0]
    items = np.flatnonzero(out)
    best_fit(lengths, items[np.argsort(-lengths[items], kind="stable")], child, spaces := free.tolist(), capacity)
    del spaces
    return compact(child)


#: born: crossovers of the island so far; won: how many of its children displaced a grouping of the pool.
STATE = "shard long, island int, lengths binary, genome binary, bins int, worth double, born long, won long"


def _rows(shard, island, lengths, pool, capacity, born=0, won=0) -> pd.DataFrame:
    kept = sorted(((fitness(lengths, g, capacity), g.tobytes()) for g in pool))
    seen = list({g: f for f, g in kept}.items())[:POPULATION]
    return pd.DataFrame({"shard": shard, "island": island, "lengths": lengths.astype("<i4").tobytes(), "genome": [g for g, _ in seen], "bins": [f[0] for _, f in seen], "worth": [f[1] for _, f in seen], "born": born, "won": won})


def evolve(shard: int, island: int, lengths: np.ndarray, pool: list[np.ndarray], seed: int, capacity: int = CAPACITY, offspring: int = OFFSPRING) -> tuple[list[np.ndarray], int, int]:
    """(the pool after ``offspring`` crossovers, crossovers, children that displaced the worst of the pool)."""
    rng = np.random.Generator(np.random.PCG64([abs(shard), island, seed]))
    marked = sorted(((fitness(lengths, g, capacity), i, g) for i, g in enumerate(pool)), key=lambda x: x[:2])
    born = won = 0
    for k in range(offspring if len(lengths) else 0):
        i, j = rng.choice(len(marked), 2, replace=len(marked) < 2)
        child = crossover(lengths, marked[min(i, j)][2], marked[max(i, j)][2], rng, capacity)
        marked.append((fitness(lengths, child, capacity), len(pool) + k, child))
        marked = sorted(marked, key=lambda x: x[:2])[: max(POPULATION, len(pool))]
        born += 1
        won += any(m[1] == len(pool) + k for m in marked)
    return [g for _, _, g in marked], born, won


def evolved(rest: DataFrame, capacity: int, islands: int, rounds: int) -> DataFrame:
    """The islands' pools (``STATE``) after all rounds, for pieces (_shard, length) of less than the capacity."""

    def seed(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = np.sort(pdf["length"].to_numpy())[::-1].astype(np.int64)
        at = int(pdf["_shard"].iloc[0])
        out = []
        for i in range(islands):
            rng = np.random.Generator(np.random.PCG64([at, i]))
            out.append(_rows(at, i, lengths, [first_fits(lengths, rng, capacity, 0.0 if k == 0 else 0.02 * k) for k in range(POPULATION)], capacity))
        return pd.concat(out)

    def step(turn: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            at, i = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
            lengths = np.frombuffer(pdf["lengths"].iloc[0], "<i4").astype(np.int64)
            pool, born, won = evolve(at, i, lengths, [np.frombuffer(g, np.int32) for g in sorted(pdf["genome"])], turn, capacity)
            return _rows(at, i, lengths, pool, capacity, int(pdf["born"].max()) + born, int(pdf["won"].max()) + won)

        return run

    state = rest.select("_shard", "length").groupBy("_shard").applyInPandas(seed, STATE)
    best_first = F.struct("bins", "worth", "genome")
    for turn in range(rounds):
        if turn:  # the elite also goes to the next island of its shard
            elite = state.groupBy("shard", "island", "lengths").agg(F.min(best_first).alias("e"))
            moved = elite.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), "lengths", F.col("e.genome").alias("genome"), F.col("e.bins").alias("bins"), F.col("e.worth").alias("worth"), F.lit(0).cast("long").alias("born"), F.lit(0).cast("long").alias("won"))
            state = state.unionByName(moved)
        state = materialize(state.groupBy("shard", "island").applyInPandas(step(turn), STATE), "islands")
    return state


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """The pieces (any columns, with length from 1 to capacity) with sequence_id and offset."""
    pieces = pieces.drop("sequence_id", "offset")
    own = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = own.where(F.col("length") == capacity).withColumn("sequence_id", -F.col("_row") - 1).withColumn("offset", F.lit(0).cast("long")).drop("_row")
    rest = own.where((F.col("length") < capacity) & (F.col("length") > 0))
    shards = max(1, -(-rest.count() // shard))
    rest = rest.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))

    def place(pdf: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins = np.frombuffer(best["genome"].iloc[0], np.int32).astype(np.int64)
        lengths = pdf["length"].to_numpy()
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        starts = ends - lengths[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty(len(pdf), np.int64)
        offset[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        return pdf.drop(columns=["_row", "_shard"]).assign(sequence_id=pdf["_shard"] * (1 << 24) + bins, offset=offset)

    state = evolved(rest, capacity, islands, rounds)
    best = state.groupBy("shard").agg(F.min(F.struct("bins", "worth", "genome"))["genome"].alias("genome"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    packed = rest.groupBy("_shard").cogroup(best.groupBy("shard")).applyInPandas(place, schema)
    return packed.unionByName(full)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(cut_documents(table(spark, sf_dir, "documents"), path, keep_ids=False))
