"""Whitening of embeddings by the singular values of their centred rows.

Entries become integers (``scaled``), so the sums S and each row's deviations n*x - S are exact. MLlib's ``RowMatrix``
takes the rows (n*x - S) / n and ``computeSVD`` gives the right singular vectors, which are the components, and singular
values s; the eigenvalue of a component is s**2 / n, since MLlib's values have no divisor. The trace of the covariance comes
from the exact deviations in a sum of its own, not from the singular values, of which only some may be asked for.

All components are asked for, so that MLlib decomposes the Gram matrix by LAPACK to double precision; its d x d entries are
the only thing that reaches the driver, whatever the number of rows.

Defined cases: rows with a null vector, a null or non-finite entry, or an entry of magnitude 2**30 or more (beyond exact
longs) are dropped; so are rows whose length is not the most frequent one (the longer of two). Components whose variance is
under 1e-10 of the largest are left out: double precision cannot tell them from none, so fewer rows than dimensions, or
equal rows only, give fewer components or no row. A null or repeated vec_id is a row like any other. A deviation past the
range of a long is null. Extra columns do not pass. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lists, table

COMPONENTS = 32
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**30
#: Variance of a component against that of the first, at least.
LEAST = 1e-10
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _exact(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST)


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of longs) of the rows that can be used."""
    fine = F.forall("embedding", _exact) & (F.size("embedding") > 0)
    x = F.transform("embedding", lambda c: F.when(_exact(c), F.floor(c.cast("double") * SCALE) + SHIFT))  # Spark may evaluate it first
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", x.alias("x"))


def _svd(rows: DataFrame, c: str) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(c).alias("v")), "v"))


def _integers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _deviations(off: np.ndarray) -> list[int | None]:
    """The sums of squares of the rows as Python integers where 64 bits might not do; null past the range of a long."""
    if not off.size or float(np.abs(off).max()) ** 2 * off.shape[1] < 2.0**62:
        return (off * off).sum(axis=1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in off.tolist()]
    return [s if s < 2**63 else None for s in sums]


class Whitening:
    """A fitted map: ``n``, ``sums`` (per dimension), ``trace``, ``values`` (eigenvalues, falling), ``vectors`` (columns)."""

    def __init__(self, n: int, sums: np.ndarray, trace: float, values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.trace, self.values, self.vectors = n, sums, trace, values, vectors

    def centred(self, rows: DataFrame) -> DataFrame:
        """vec_id, deviation, spread (the same in double), c = (n * x - S) / n."""
        n, sums = self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                off = n * _integers(b.column(1)) - sums[None, :]
                spread = ((off / n) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_deviations(off), pa.int64()), pa.array(spread), lists(list(off / n), pa.float64())], names=["vec_id", "deviation", "spread", "c"])

        return rows.mapInArrow(run, "vec_id long, deviation long, spread double, c array<double>")

    def project(self, rows: DataFrame) -> DataFrame:
        """vec_id, deviation, y: the centred rows on the components, over the roots of the eigenvalues."""
        to = self.vectors / np.sqrt(self.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(list(_integers(b.column(2)) @ to), pa.float64())], names=["vec_id", "deviation", "y"])

        return self.centred(rows).select("vec_id", "deviation", "c").mapInArrow(run, "vec_id long, deviation long, y array<double>")


def usual(rows: DataFrame) -> DataFrame:
    """The rows whose length is the most frequent one."""
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (sizes.d if sizes else 0))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """None where no dimension varies. ``rows`` as ``scaled`` gives them, of one length."""
    got = rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("s"), F.count("*").alias("n")).orderBy("pos").collect()
    if not got:
        return None
    model = Whitening(got[0].n, np.array([r.s for r in got], dtype=np.int64), 0.0, np.ones(0), np.ones((0, 0)))
    centred = model.centred(rows)
    model.trace = centred.agg(F.sum("spread")).first()[0] / model.n
    if not model.trace > 0:
        return None
    found = _svd(centred, "c").computeSVD(len(got), rCond=1e-12)
    values = np.array(found.s.toArray()) ** 2 / model.n
    k = min(components, int((values > LEAST * values[0]).sum()))
    model.values, model.vectors = values[:k], np.array(found.V.toArray())[:, :k]
    return model


def identity_error(model: Whitening, whitened: DataFrame) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity."""
    gram = np.array(_svd(whitened, "y").computeGramianMatrix().toArray()) / model.n
    return float(np.abs(gram - np.eye(len(gram))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = usual(scaled(vectors))
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    whitened = model.project(rows)
    error, share = identity_error(model, whitened), [float(v) for v in model.values / model.trace]
    out = whitened.select("vec_id", "deviation", F.posexplode("y").alias("pos", "whitened"))
    explained = F.get(F.array(*map(F.lit, share)), F.col("pos"))
    return out.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
