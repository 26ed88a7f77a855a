"""Quality classification by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; unlabelled is the text of the corpus whatever its label. Statistics of all
texts are one narrow table. Over all of it that is not held out are counted: the quantile bins of each statistic (on a grid
of ``GRID`` steps) and, under a classifier of positives against unlabelled, how much of either side scores above each
cut: the class prior is the least ratio of these tails. Only weights are fitted on samples, of labelled rows: a logistic
model minimises the non-negative unbiased risk of Kiryo et al. (2017): pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)]).

Defined cases: a null text is empty and gets a score; held-out rows are in no sample and no count; without positives every
score is 1, without labelled rows of any kind too; whole texts are used, of any length; repeated labels of a document count
once; repeated rows repeat their result; labels and rows without an id do not meet; an empty table gives an empty
result; extra columns do not pass.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held_out, lists, materialize, table, whole_text

#: Rows of the two samples of labelled rows (expected numbers): of quality 1, and of any label, which is not looked at.
POSITIVES, UNLABELLED, THRESHOLD = 4000, 8000, 0.3
#: Steps of 1 in which statistics are counted, and of 1 in which scores are.
GRID, STEPS, FAR = 1 << 16, 1 << 10, 30
SHARES = [0.02, 0.05, 0.1, 0.2, 0.5, 0.8, 0.9, 0.95, 0.98]
_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123))
_LEAD, _TRAIL, _DIGIT, _SYMBOL = bytes(range(192, 256)), bytes(range(128, 192)), bytes(range(48, 58)), b"!#$%&*+<=>@[]^_`{|}~\\/"


def statistics(text: str) -> np.ndarray:
    """Bounded measures of a text; linear in its length."""
    b = text.encode()
    n = max(1, len(b) - (len(b) - len(b.translate(None, _TRAIL))))
    words = b.split()
    w = max(1, len(words))
    lines = [x.rstrip() for x in b.split(b"\n")]
    seen = Counter(words)
    same = list(map(operator.eq, words, words[1:]))
    upper, lead = len(b) - len(b.translate(None, _UPPER)), len(b) - len(b.translate(None, _LEAD))
    letters = len(b) - len(b.translate(None, _LETTER)) + lead
    digits, symbols = (len(b) - len(b.translate(None, k)) for k in (_DIGIT, _SYMBOL))
    return np.array([
        min(np.log1p(len(words)), 12) / 6, len(seen) / w, sum(same) / w, max(seen.values(), default=0) / w,
        sum(c for c in seen.values() if c > 2) / w, upper / max(1, letters), sum(map(bytes.isupper, words)) / w, min(symbols / w, 2),
        digits / n, 1 - len(set(lines)) / len(lines), min(letters / w, 20) / 10, sum(x.endswith((b".", b"!", b"?", b"\xe2\x80\xa6", b'"')) for x in lines) / len(lines),
        letters / n, min(len(lines) / w, 1), sum(len(x) == 0 for x in lines) / len(lines), float(not words),
    ])


def _fit(loss_grad, dim: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    for t in range(1, steps + 1):
        g = loss_grad(w) + 1e-3 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def separator(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Weights of a classifier of p against u, both sides weighing the same."""
    x = np.vstack([p, u])
    y = np.r_[np.ones(len(p)), np.zeros(len(u))]
    weight = np.where(y == 1, 0.5 / len(p), 0.5 / len(u))
    return _fit(lambda w: x.T @ (weight * (_sigmoid(x @ w) - y)), x.shape[1])


def steps_of(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -FAR, FAR) * STEPS).astype(np.int64)


def least_ratio(good: np.ndarray, every: np.ndarray) -> float:
    """The least share of all rows over the share of positives above a cut that a fifth of the positives exceed; counts by
    score, ascending."""
    above_p, above_u = (np.cumsum(x[::-1])[::-1] / max(1, x.sum()) for x in (good, every))
    held = above_p >= 0.2
    return float(np.clip((above_u[held] / above_p[held]).min() if held.any() else 0.95, 0.05, 0.95))


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The positives' share of the unlabelled rows, by tails of both under a classifier of p against u."""
    w = separator(p, u)
    steps, at = np.unique(np.r_[steps_of(p @ w), steps_of(u @ w)], return_inverse=True)
    return least_ratio(*(np.bincount(x, minlength=len(steps)) for x in (at[: len(p)], at[len(p) :])))


def non_negative_risk(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk with the logistic loss."""

    def grad(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        positive = -prior * p.T @ _sigmoid(-zp) / len(p)
        negative = u.T @ _sigmoid(zu) / len(u) - prior * p.T @ _sigmoid(zp) / len(p)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return positive + negative if risk >= 0 else -negative

    return _fit(grad, p.shape[1])


def with_ones(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows of statistics with indicators of their bins and a constant."""
    bins = (x[:, :, None] > edges[None]).astype(np.float64).reshape(len(x), -1)
    return np.concatenate([x, bins, np.ones((len(x), 1))], axis=1)


class Model:
    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray, edges: np.ndarray | None = None, prior=class_prior):
        """edges: by statistic; ``prior(p, u)`` gets the samples with their bins. Without rows of both kinds all scores are 1."""
        self.weights = None
        if len(positives) and len(unlabelled):
            self.edges = np.quantile(unlabelled, SHARES, axis=0).T if edges is None else edges
            p, u = with_ones(positives, self.edges), with_ones(unlabelled, self.edges)
            self.prior = prior(p, u)
            self.weights = non_negative_risk(p, u, self.prior)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.ones(len(x))
        return _sigmoid(with_ones(x, self.edges) @ self.weights)

    def score(self, text: str) -> float:
        return float(self.scores(statistics(text)[None])[0])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 16))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), lists([statistics(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def bin_edges(x: DataFrame) -> np.ndarray:
    """(statistics, SHARES): for each the grid step at or below the value of that rank, counted over all rows of x."""
    counts = x.select(F.posexplode("x").alias("k", "v")).groupBy("k", F.floor(F.col("v") * GRID).alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("k")  # rows are steps of a grid
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
    counts = counts.select("k", "b", "n", "upto", "all", F.explode(F.array(*map(F.lit, SHARES))).alias("share"))
    rank = F.floor((F.col("all") - 1) * F.col("share"))
    got = counts.where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)).orderBy("k", "share").collect()
    return np.array([r.b / GRID for r in got]).reshape(-1, len(SHARES))


def tail_prior(x: DataFrame, edges: np.ndarray, w: np.ndarray) -> float:
    """The class prior from the scores of all rows (x, good) under the weights: the driver gets a count for each step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(steps_of(with_ones(_rows(b.column(0)), edges) @ w)), b.column(1)], names=["step", "good"])

    counts = x.select("x", "good").mapInArrow(run, "step long, good boolean").groupBy("step").agg(F.count_if("good").alias("g"), F.count("*").alias("n"))
    got = sorted(tuple(r) for r in counts.collect())
    return least_ratio(np.array([g for _, g, _ in got]), np.array([n for *_, n in got]))


def fitted(x: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from statistics (doc_id, x) outside the held-out fold and labels; the driver holds about that many vectors of
    16 numbers and counts on a grid."""
    own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_q"))
    rows = x.where(~held_out()).join(own, "doc_id", "left")
    rows = materialize(rows.select("doc_id", "x", F.coalesce(F.col("_q") == 1, F.lit(False)).alias("good"), F.col("_q").isNotNull().alias("labelled")), "statistics")
    n_good, n_all = rows.agg(F.count_if("good"), F.count_if("labelled")).first()

    def some(df: DataFrame, most: int, n: int, seed: int) -> np.ndarray:
        few = df.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < min(1.0, most / max(1, n)) * (1 << 20))
        return np.array(sorted(r.x for r in few.select("x").collect())).reshape(-1, 16)

    p, u = some(rows.where("good"), positives, n_good, 1), some(rows.where("labelled"), unlabelled, n_all, 2)
    if not len(p) or not len(u):
        return Model(p, u)
    edges = bin_edges(rows)
    return Model(p, u, edges, lambda a, b: tail_prior(rows, edges, separator(a, b)))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    return fitted(measured(docs.where(~held_out())), labels, positives, unlabelled)


def scored(x: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(_rows(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return x.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: how likely the text is good."""
    return scored(measured(docs), model)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    x = materialize(measured(docs), "measured")
    out = scored(x, fitted(x, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
