"""Pages of a table by keyset: each starts after the last row of the one before, and nothing before it is sorted again.

The bound on the first key reaches the scan; every task keeps the page's worth of its least rows. A cursor kept in the
shared folder lets a sweep go on after a restart. Rows that are put in ahead of the cursor come in their turn; those behind
it are for the next run. Keys end in one that is unique; rows with a null key are on no page."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import find_matches

#: Rows of a page of a sweep, and hits that a reader of a page is shown.
PAGE, PAGE_HITS = 50, 5_000


def after(keys: Sequence[str], values: Sequence) -> Column:
    """Rows behind the values in the order of the keys."""
    rest = F.lit(False)
    for k, v in reversed(list(zip(keys, values, strict=True))):
        rest = (F.col(k) >= v) & ((F.col(k) > v) | rest)
    return rest


def next_page(rows: DataFrame, keys: Sequence[str], cursor: Sequence | None, size: int = PAGE) -> tuple[list, Sequence | None]:
    """(the page's rows in order, the cursor after it): an empty page leaves the cursor."""
    rows = rows.where(after(keys, cursor)) if cursor is not None else rows
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    page = rows.orderBy(*keys).limit(size).collect()
    return page, [page[-1][k] for k in keys] if page else cursor


class Cursor:
    """A position in ``folder`` that survives the driver; the newest file counts, and each is written whole."""

    def __init__(self, spark: SparkSession, folder: str, types: str):
        self.spark, self.folder, self.types = spark, folder.rstrip("/"), types

    def _files(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [p for p in names if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def load(self) -> list | None:
        if not (files := self._files()):
            return None
        return list(self.spark.read.schema(self.types).parquet(f"{self.folder}/{files[-1]}").first())

    def save(self, values: Sequence) -> None:
        n = (self._files() or [-1])[-1] + 1
        self.spark.createDataFrame([tuple(values)], self.types).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{n}")


def sweep_expired(documents: Callable[[], DataFrame], purge: Callable[[list], set], cursor: Cursor | None = None, size: int = PAGE, pages: int | None = None) -> tuple[int, set, bool]:
    """(documents purged, ids that failed, whether something may remain). ``documents()`` gives what is expired at the time
    (doc_id, expires_at, parent); ``purge(rows)`` deletes a page's documents and returns the ids that it could not delete: they
    stay for the next run. A child on the page of its parent goes with it. ``pages``: how many a run may take."""
    keys, done, failed, at = ["expires_at", "doc_id"], 0, set(), cursor.load() if cursor else None
    while pages is None or pages > 0:
        page, at = next_page(documents(), keys, at, size)
        if not page:
            return done, failed, False
        own = {r.doc_id for r in page}
        work = [r for r in page if r.parent is None or r.parent not in own]
        bad = purge(work)
        lost = bad | {r.doc_id for r in page if r.parent in bad}
        failed |= lost
        done += len(own - lost)
        if cursor:
            cursor.save(at)
        pages = None if pages is None else pages - 1
    return done, failed, bool(next_page(documents(), keys, at, 1)[0])


def search_page(rules: DataFrame, pages: DataFrame, doc_id: int, page: int, most: int = PAGE_HITS) -> DataFrame:
    """The first hits on one page, in order; none for a page that the document has not. Only that page is read."""
    own = pages.where((F.col("doc_id") == doc_id) & (F.col("page") == page))
    return find_matches(rules, own)[0].orderBy("start", "end", "rule_id").limit(most)


