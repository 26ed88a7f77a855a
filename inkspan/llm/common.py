"""What the operators share: table access, shared scratch files, Arrow helpers, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which all executors share; where that is unset, a local one, but only
    for a local master: on a cluster the executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="inkspan-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete scratch files that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table_of(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """(the rows read back from a Parquet table in the shared folder, its path)."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; it outlives any executor. Results are lazy and may read
    it at any time: whoever owns ``spark.checkpoint.dir`` clears it after the job."""
    return table_of(df, what)[0]


def whole_text(c: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(c), F.lit(""))


def held_out(c: str = "doc_id") -> Column:
    """The fold that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lists(arrays: list, kind: pa.DataType) -> pa.Array:
    """A list column from NumPy arrays without boxing."""
    import numpy as np

    ends = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``most`` bytes of ``column`` (one row at least)."""
    for b in batches:
        start = size = 0
        lengths = pc.binary_length(b.column(b.schema.get_field_index(column))).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < b.num_rows:
            yield b.slice(start)


#: Parts that the rows of one key are dealt to where a key may hold a large share of them.
SALT = 16


def join_salted(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", by: str | None = None) -> DataFrame:
    """rows joined to ``few``, which has a key once: few's rows are copied ``SALT`` times and the rows of a key are dealt
    to as many tasks, by the column ``by`` (or all columns)."""
    # never null to the optimiser's knowledge: else it filters nulls below whatever deals the rows, which is then not reused
    salt = F.coalesce(F.pmod(F.xxhash64(by or F.struct(*rows.columns)), F.lit(SALT)).cast("int"), F.lit(0))
    copied = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", salt).join(copied, [key, "_salt"], how).drop("_salt")


def _star(df: DataFrame) -> DataFrame:
    """(u, m): every node with the least of itself and its neighbours; minima are combined before the shuffle."""
    return df.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for undirected edges of comparable ids; component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014); every round's edges are a table in
    the shared folder, and those of the round before are deleted. Minima are combined on the map side, so a hub never
    meets its neighbours in one task's memory. Self-loops and nulls are dropped; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    x, y = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    now, path = table_of(edges.where(F.col(a) != F.col(b)).select(y, x).distinct(), "edges")  # u > v

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    seen = mark(now)
    while seen[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_star(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))
        small = large.join(low, "u").select(F.explode(pair).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()
        old = path
        now, path = table_of(small, "edges")
        discard(spark, old)
        last, seen = seen, mark(now)
        if seen == last:
            break
    kind = edges.schema[a].dataType
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))
