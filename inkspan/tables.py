"""Tables that cut a plan's lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a temporary folder, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="inkspan-tables-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def kept_at(df: DataFrame, what: str, *by: str) -> str:
    """The path of a Parquet table of the rows in the shared folder, in folders by the columns named. What was shuffled for
    it goes when it is written."""
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}", spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before) if before is not None else spark.conf.unset(clean)
    return path


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows, written once to a Parquet table in the shared folder and read back; whoever owns it clears it later."""
    return df.sparkSession.read.schema(df.schema).parquet(kept_at(df, what))
