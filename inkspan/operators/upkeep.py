"""Rules of a batch of documents, kept up with changes: create, update and remove, a numbered epoch at a time.

What rules write is derived from them and from the documents, and only what an epoch changes is derived anew: rules whose
pattern, category or state becomes another are searched for in the documents of their batch, documents that are new in the
rules of theirs. Rows carry their epoch; a tombstone says that a rule's rows of earlier epochs are gone. Every epoch is a
folder of its own that a repeated run replaces, so a failed run can be run again, and any series of changes gives what a
rebuild from its outcome gives.

Defined cases: changes of unknown rules are passed over, so is an update that changes nothing; a null field of an update
keeps what was; a rule made again after its removal is a new one; patterns that do not compile end the run before anything
is written. Changes of an epoch are in order of ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rules import find_matches, to_redactions

SPEC = "pattern string, kind string, match_case boolean, whole_word boolean, category string, enabled boolean, origin long"
CHANGES = f"seq long, op string, rule_id string, batch_id string, {SPEC}"
RULES = f"rule_id string, batch_id string, {SPEC}"
ROWS = "rule_id string, doc_id long, page int, start int, end int, text string, category string, from_origin boolean, epoch long"
FIELDS = [f.split()[0] for f in SPEC.split(", ")]


def folded(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """The rules after the changes: for each field the last one said since the rule was made; removed rules go."""
    before = rules.select(F.lit(-1).cast("long").alias("seq"), F.lit("create").alias("op"), "rule_id", "batch_id", *FIELDS)
    every = before.unionByName(changes.select("seq", "op", "rule_id", "batch_id", *FIELDS))
    w = Window.partitionBy("rule_id")
    said = every.withColumn("_made", F.max(F.when(F.col("op") == "create", F.col("seq"))).over(w)).withColumn("_gone", F.max(F.when(F.col("op") == "remove", F.col("seq"))).over(w))
    live = said.where("_made is not null and (_gone is null or _gone < _made) and seq >= _made and op != 'remove'")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    out = live.groupBy("rule_id").agg(last("batch_id"), *map(last, FIELDS))
    fills = {"kind": "literal", "match_case": False, "whole_word": False, "category": "other", "enabled": True}
    return out.select("rule_id", "batch_id", *(F.coalesce(c, F.lit(fills[c])).alias(c) if c in fills else c for c in FIELDS))


def written(rules: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """What enabled rules write in the documents (doc_id, batch_id) of their batches, without an epoch. Only pages of those
    documents are searched."""
    live = rules.where("enabled")
    held = documents.select("doc_id", "batch_id").join(live.select("batch_id").distinct(), "batch_id", "left_semi")
    own = pages.select("doc_id", "page", "text").join(held.select("doc_id"), "doc_id", "left_semi")
    hits = find_matches(live, own)[0]
    both = hits.join(held, "doc_id").join(F.broadcast(live.select("rule_id", "batch_id", "origin")), ["rule_id", "batch_id"])
    return both.select("rule_id", F.col("doc_id").cast("long"), "page", "start", "end", "text", "category", F.coalesce(F.col("origin") == F.col("doc_id"), F.lit(False)).alias("from_origin"))


class BatchRules:
    """The rules and rows of ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str, epoch: int | None = None) -> str:
        return f"{self.folder}/{table}" + (f"/at={epoch}" if epoch is not None else "")

    def _epochs(self) -> list[int]:
        """Finished epochs: those whose mark, written last, is there."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path("done"))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()[3:]) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, table: str, schema: str, epochs: list[int]) -> DataFrame:
        paths = [self._path(table, e) for e in epochs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rules(self, before: int | None = None) -> DataFrame:
        """The rules after the last epoch (before one)."""
        last = [e for e in self._epochs() if before is None or e < before][-1:]
        return self._read("rules", RULES, last)

    def rows(self) -> DataFrame:
        """What the rules write, with the epoch of each row."""
        epochs = self._epochs()
        gone = self._read("gone", "rule_id string, until long", epochs).groupBy("rule_id").agg(F.max("until").alias("until"))
        rows = self._read("rows", ROWS, epochs).join(F.broadcast(gone) if epochs else gone, "rule_id", "left")
        return rows.where("until is null or epoch >= until").drop("until")

    def apply(self, epoch: int, changes: DataFrame, documents: DataFrame, pages: DataFrame, arrived: DataFrame | None = None) -> None:
        """One epoch's changes, and documents (doc_id) that arrived in it. Epochs ascend; the last one may be run again."""
        if any(e > epoch for e in self._epochs()):
            raise ValueError(f"epoch {epoch} is not the last one")
        old = self.rules(before=epoch)
        new = folded(old, changes)
        new.write.mode("overwrite").parquet(self._path("rules", epoch))
        new = self.spark.read.schema(RULES).parquet(self._path("rules", epoch))
        named = lambda df, n: df.select(F.col("rule_id"), F.struct("batch_id", *FIELDS).alias(n))
        made = changes.where("op = 'create'").select("rule_id").distinct().withColumn("_again", F.lit(True))
        both = named(old, "_old").join(named(new, "_new"), "rule_id", "full").join(made, "rule_id", "left")
        moved = both.where(~F.col("_old").eqNullSafe(F.col("_new")) | F.col("_again")).select("rule_id")
        moved.select("rule_id", F.lit(epoch).cast("long").alias("until")).write.mode("overwrite").parquet(self._path("gone", epoch))
        moved = self.spark.read.schema("rule_id string").parquet(self._path("gone", epoch))
        rows = written(new.join(moved, "rule_id", "left_semi"), documents, pages)
        if arrived is not None:  # rules that did not change, in what is new
            late = documents.join(arrived.select("doc_id").distinct(), "doc_id", "left_semi")
            rows = rows.unionByName(written(new.join(moved, "rule_id", "left_anti"), late, pages))
        rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(self._path("rows", epoch))
        self.spark.range(1).write.mode("overwrite").parquet(self._path("done", epoch))

    def redactions(self) -> DataFrame:
        return to_redactions(self.rows())


def rebuilt(changes: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """What all changes come to (seq ascends over all), derived at once."""
    return written(folded(changes.limit(0), changes), documents, pages)
