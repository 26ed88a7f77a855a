"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

A text is a vector of hashed character trigrams (lower-cased letters, everything else a space), square-rooted and of
unit length. Linear SVMs (squared hinge, dual coordinate descent) are trained on the driver from a bounded sample of
labelled rows: one against the rest for each family, one for each pair of languages of a family. A language's votes
decide within the family; ties go to the larger sum of margins, then to the first name.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without a label or in the held-out fold
teach nothing; without any labelled row every text is ``und``; whole texts are used, of any length; repeated rows
repeat their result; an empty table gives an empty result; extra columns do not pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

#: Labelled rows to train on, over all languages together (an expected number; 20 a language at least).
SAMPLE = 3200
DIM, UNKNOWN = 2048, "und"
#: What ``accept`` asks of the score of a text of so many letters or more: texts in a language or script that nothing was
#: learnt of stay below it. Shorter ones give too little to judge by.
LEAST, LETTERS = 0.45, 100
#: Closely related languages; a language in no family is one of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg"),
}
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def family(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang in own), lang)


def features(text: str, dim: int = DIM) -> np.ndarray:
    b = (" " + text.lower() + " ").encode().translate(_LETTERS)
    out = np.zeros(dim)
    for i in range(0, len(b), 1 << 20):  # with two bytes of overlap
        a = np.frombuffer(b[i : i + (1 << 20) + 2], np.uint8).astype(np.uint32)
        if len(a) > 2:
            h = ((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)) >> np.uint32(32 - dim.bit_length() + 1)
            out += np.bincount(h, minlength=dim)
    blank = ((0x202020 * 2654435761) & 0xFFFFFFFF) >> (33 - dim.bit_length())
    out[blank] = 0
    out = np.sqrt(out)
    return (out / max(np.sqrt((out**2).sum()), 1e-12)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 15, seed: int = 42) -> np.ndarray:
    """Weights (the last is the bias) for labels of +1 and -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x**2).sum(axis=1) + 0.5 / c
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = max(alpha[i] - (y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / c) / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


class Model:
    def __init__(self, rows: list[tuple[str, np.ndarray]]):
        self.langs = sorted({k for k, _ in rows})
        self.families = sorted({family(k) for k in self.langs})
        self.within = {f: [k for k in self.langs if family(k) == f] for f in self.families}
        x = np.array([v for _, v in rows]) if rows else np.zeros((0, DIM), np.float32)
        lang = np.array([k for k, _ in rows])
        fam = np.array([family(k) for k, _ in rows])
        self.by_family = np.array([linear_svm(x, np.where(fam == f, 1, -1)) for f in self.families] if len(self.families) > 1 else np.zeros((len(self.families), x.shape[1] + 1), np.float32))
        self.pairs = {}
        for own in self.within.values():
            for a, b in combinations(own, 2):
                rows_ab = (lang == a) | (lang == b)
                self.pairs[a, b] = linear_svm(x[rows_ab], np.where(lang[rows_ab] == a, 1, -1))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        x = np.append(features(text), np.float32(1))
        margins = self.by_family @ x
        top = int(margins.argmax())
        sure = 1.0 if len(self.families) == 1 else 1 / (1 + np.exp(-4 * float(margins[top])))
        own = self.within[self.families[top]]
        votes, sums, least = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0), dict.fromkeys(own, 1.0)
        for a, b in combinations(own, 2):
            m = float(self.pairs[a, b] @ x)
            won, lost = (a, b) if m > 0 else (b, a)
            votes[won] += 1
            sums[a] += m
            sums[b] -= m
            p = 1 / (1 + np.exp(-4 * abs(m)))
            least[won], least[lost] = min(least[won], p), min(least[lost], 1 - p)
        best = min(own, key=lambda k: (-votes[k], -sums[k], k))
        return best, float(sure * least[best])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled rows outside the held-out fold; the driver holds about ``sample`` vectors."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([])
    each = max(20, sample // len(counts))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))))
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(k, features(t).tobytes()) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if any(map(str.isalpha, t))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.binary())], names=["lang", "x"])

    got = some.select("lang", "text").mapInArrow(run, "lang string, x binary").collect()
    return Model(sorted(((r.lang, np.frombuffer(bytes(r.x), np.float32)) for r in got), key=lambda r: (r[0], r[1].tobytes())))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id unless given) with lang_pred and score; the text is the only input of a prediction."""
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", lang_pred string, score double"
    return docs.select(*(F.col(f"`{k}`") for k in keep), F.col("text").alias("_text")).mapInArrow(run, schema)


def accept(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The documents, all columns, in a language that was learnt: those with a letter whose prediction has a score of
    ``least`` or more, or that have under ``LETTERS`` letters; where the language (a column lang) is null, the prediction becomes it. With a model that has learnt
    none, all that hold a letter, as they are."""
    at = docs.columns.index("text")
    named = docs.columns.index("lang") if "lang" in docs.columns and docs.schema["lang"].dataType.simpleString() == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(at)]
            cols = list(b.columns)
            if model.langs:
                found = [model.predict(t) for t in texts]
                keep = [k != UNKNOWN and (s >= least or sum(map(str.isalpha, t)) < LETTERS) for t, (k, s) in zip(texts, found, strict=True)]
                if named is not None:
                    lang = cols[named].to_pylist()
                    cols[named] = pa.array([own if own is not None or k == UNKNOWN else k for own, (k, _) in zip(lang, found, strict=True)], b.schema.field(named).type)
            else:
                keep = [any(map(str.isalpha, t or "")) for t in texts]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score")
