"""Event streams: the latest state of each key, counts in windows, sessions, and token buckets with keyed state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_state(events: DataFrame, key: str = "user_id", ts: str = "ts", ident: str = "event_id", kind: str = "event_type") -> DataFrame:
    """key, status, at: the newest event wins, the larger id on ties; batch or stream (complete or update mode)."""
    return events.groupBy(key).agg(F.max(F.struct(F.col(ts), F.col(ident), F.col(kind))).alias("_l")).select(key, F.col(f"_l.{kind}").alias("status"), F.col(f"_l.{ts}").alias("at"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Extension: events by window and type; with ``late`` as a watermark on streams."""
    events = events.withWatermark("ts", late) if late else events
    rows = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Extension: sessions of each user, closed by a gap."""
    events = events.withWatermark("ts", late) if late else events
    rows = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def take(tokens: float, since: float, now: float, burst: float, refill: float) -> tuple[bool, float, float, int]:
    """(allowed, tokens left, time, ms to wait) of a request at a bucket that refills ``refill`` tokens a second."""
    have = min(burst, tokens + max(0.0, now - since) * refill)
    if have < 1:
        return False, have, now, math.ceil((1 - have) / refill * 1000)
    return True, have - 1, now, 0


BUCKET = "user_id long, event_id long, ts timestamp, allowed boolean, remaining long, retry_after_ms long"


def _fold(pdf: pd.DataFrame, state: tuple[float, float] | None, burst: float, refill: float) -> tuple[pd.DataFrame, tuple[float, float]]:
    out = []
    for r in pdf.sort_values(["ts", "event_id"], kind="stable").itertuples():
        now = r.ts.timestamp()
        ok, left, at, wait = take(*(state or (burst, now)), now, burst, refill)
        state = (left, at)
        out.append((r.user_id, r.event_id, r.ts, ok, math.floor(left) if ok else 0, wait))
    return pd.DataFrame(out, columns=["user_id", "event_id", "ts", "allowed", "remaining", "retry_after_ms"]), state or (burst, 0.0)


def token_buckets(events: DataFrame, limit: float = 2, seconds: float = 86400.0) -> DataFrame:
    """Decisions of a bucket for each user over a batch, in order of time."""
    own = events.select("user_id", "event_id", "ts")
    return own.groupBy("user_id").applyInPandas(lambda pdf: _fold(pdf, None, limit, limit / seconds)[0], BUCKET)


def token_bucket_stream(events: DataFrame, limit: float = 2, seconds: float = 86400.0) -> DataFrame:
    """The same over a stream; the state is (tokens, time)."""

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, held = _fold(pd.concat(list(pdfs)), state.get if state.exists else None, limit, limit / seconds)
        state.update(tuple(map(float, held)))
        yield out

    own = events.select("user_id", "event_id", "ts")
    return own.groupBy("user_id").applyInPandasWithState(run, BUCKET, "tokens double, at double", "append", GroupStateTimeout.NoTimeout)


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream without repeated event ids."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def carry_to_arrivals(stream: DataFrame, rules_of, write, checkpoint: str):
    """Apply the rules of the moment to documents as they arrive. rules_of() gives the rules' table, write(df, epoch) stores
    matches; epochs may repeat after a failure, so write must replace by epoch."""
    from inkspan.operators import rules

    def step(batch: DataFrame, epoch: int) -> None:
        write(rules.to_redactions(rules.find_matches(rules_of(), batch)[0]), epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
