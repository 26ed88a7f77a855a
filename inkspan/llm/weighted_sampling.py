"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

Terms are shingles of five words (lower-cased, split at ASCII white space; fewer words: the whole sequence), weighted by
their count. For sample k a term of weight w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1), sets t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r; the term with the least ln a gives the sample (term, t). Two documents agree on a sample
with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima.

The draws come from two pools of 65,536 rows, one of c and one of (r, b), that two parts of a multiplicative hash of
(term, k) pick from: 2**32 different draws, so that those of a long document's terms differ as well; what is equal even
then is ordered by the term's hash.

Defined cases: a null text is empty; a text without words has the all-zero fingerprint, likeness 1 to another such text
and 0 to any other; texts are never cut; a null id sorts before all others; rows with the same id are ordered by text;
the only document's next is itself; an empty table gives an empty result; extra columns do not pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table, whole_text

WORDS, SAMPLES, SEED = 5, 128, 42
POOL = 1 << 16
#: Bytes of text for a range of ids, and ranges at most.
PART, PARTS = 1 << 25, 50_000
#: Terms handled at once, so that memory does not follow a text's length.
BLOCK = 256


class Sampler:
    def __init__(self, samples: int = SAMPLES, words: int = WORDS, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.k, self.words = samples, words
        self.r = -np.log((1 - rng.random(POOL)) * (1 - rng.random(POOL)))
        self.ln_c = np.log(-np.log((1 - rng.random(POOL)) * (1 - rng.random(POOL))))
        self.beta = rng.random(POOL)
        self.ln_c = self.ln_c.astype(np.float32)
        self.at_one = (self.r * (1 - self.beta)).astype(np.float32)  # t is 0 for weight 1
        self.odd = (rng.integers(0, 1 << 63, samples, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.code = (rng.integers(0, 1 << 63, samples, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.step = rng.integers(0, 1 << 63, words, dtype=np.uint64) | np.uint64(1)

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(hashes in order, counts) of the text's shingles."""
        from xxhash import xxh64_intdigest

        words = text.lower().encode().split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        n = min(self.words, len(h))
        with np.errstate(over="ignore"):
            s = np.full(len(h) - n + 1, n, np.uint64)
            for i in range(n):
                s = s * self.step[i] + h[i : len(h) - n + 1 + i]
                s ^= s >> np.uint64(29)
            s *= np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(32)
        return np.unique(s, return_counts=True)

    def sample(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The signature: ``samples`` codes of 16 bits; all zero without terms."""
        if not len(terms):
            return np.zeros(self.k, np.uint16)
        best, term, level = np.full(self.k, np.inf), np.zeros(self.k, np.uint64), np.zeros(self.k, np.int64)
        one = counts == 1
        rows = np.arange(self.k)
        for own, light in ((terms[one], True), (terms[~one], False)):
            weights = None if light else np.log(counts[~one])
            for i in range(0, len(own), BLOCK):
                h = own[i : i + BLOCK]
                picked = (self.odd[:, None] * h[None, :]) >> np.uint64(32)
                a = self.ln_c.take((picked >> np.uint64(16)).view(np.intp))
                at = (picked & np.uint64(0xFFFF)).view(np.intp)
                if light:
                    t = None
                    a -= self.at_one.take(at)
                else:
                    r, b = self.r.take(at), self.beta.take(at)
                    t = np.floor(weights[None, i : i + BLOCK] / r + b)
                    a = (a - r * (t - b) - r).astype(np.float32)
                j = a.argmin(axis=1)
                low, who = a[rows, j], h[j]
                won = (low < best) | ((low == best) & (who < term))
                best, term = np.where(won, low, best), np.where(won, who, term)
                level = np.where(won, 0 if t is None else t[rows, j].astype(np.int64), level)
        with np.errstate(over="ignore"):
            x = (term + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * self.code
        return (x >> np.uint64(48)).astype(np.uint16)

    def __call__(self, text: str) -> np.ndarray:
        return self.sample(*self.terms(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of samples that agree; a text without words is like such texts only."""
    if not a.any() or not b.any():
        return float(a.any() == b.any())
    return float((a == b).mean())


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (four hex digits a sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sampler(samples, words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_hex(s(x.as_py())) for x in b.column(1)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, part_bytes: int = PART) -> DataFrame:
    """doc_id, text and what a task needs to meet each document's successor by id: ranges of ids, sorted, each a partition
    of its own of about ``part_bytes`` and followed by a copy (``copy`` is 1) of the next range's first document. The
    driver sees the ranges' bounds only, two numbers a range."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own = docs.select(key.alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    n_bytes = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = min(PARTS, max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // part_bytes))
    keys = docs.select(F.col("doc_id").cast("double").alias("k"))
    bounds = np.array(sorted({int(x) for x in keys.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)}), np.int64)

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(np.int64), "right").astype(np.int32))

    ranged = own.withColumn("_part", range_of("_key"))
    least = own.select(range_of("_key").alias("_part"), "_key").groupBy("_part").agg(F.min("_key"))
    first = sorted((r[0], r[1]) for r in least.collect())  # a row for each range
    before = {k: first[i - 1][0] for i, (_, k) in enumerate(first)}  # a range's first key: the range before, for the last one's sake the last

    @F.pandas_udf("int")
    def range_before(k: pd.Series) -> pd.Series:
        return pd.Series([before.get(x, -1) for x in k.tolist()], dtype=np.int32)

    copies = own.withColumn("_part", range_before("_key")).where("_part >= 0")
    rows = ranged.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))
    return rows.repartitionById(len(bounds) + 1, F.col("_part")).sortWithinPartitions("copy", "_key", "text").select("_part", "copy", "doc_id", "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op4_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, last = Sampler(), None
        kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        for b in chunks(batches, "text"):
            rows = []
            for part, copy, doc, text in zip(*(b.column(i) for i in range(4)), strict=True):
                part, copy, text = part.as_py(), copy.as_py(), text.as_py()
                if last is None and copy:
                    continue
                mine = s(text)
                if last is not None:
                    _, doc0, text0, sig0 = last
                    half = len(text0) // 2
                    edited = text0[: len(text0) - half] + text[:half]
                    sig = s(edited)
                    rows.append((doc0, len(text0), hashlib.sha256(edited.encode()).hexdigest(), to_hex(sig0), to_hex(sig), likeness(sig0, sig), likeness(sig0, mine)))
                last = None if copy else (part, doc.as_py(), text, mine)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return in_order(table(spark, sf_dir, "documents")).mapInArrow(run, OUT)
