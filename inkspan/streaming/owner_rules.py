"""Owner rules over a stream: rules that are used live on, idle ones end.

Each owner's rules are keyed state. A document gives a row for each rule of its owner that is live at its time and keeps that
rule alive for another idle time; a timer at a rule's end looks whether it was used since, and if not forgets it. State is
in RocksDB below the query's checkpoint, so it survives lost executors and restarts.

Defined cases: rows of one micro-batch are taken in order of time, rules before documents of the same time; a rule that comes
again starts anew; a removal of an unknown rule is nothing; a document twice gives its rows twice (use ``once`` before);
rows later than the watermark are dropped by Spark; null owners are one owner.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "owner string, event string, rule_id string, doc_id long, pattern string, at timestamp"
IDLE_MS = 30 * 24 * 3600 * 1000
ORDER = {"rule": 0, "remove": 1, "document": 2}


class OwnerRules(StatefulProcessor):
    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rules = handle.getMapState("rules", "rule_id string", "pattern string, until long")

    def _keep(self, rule: str, pattern: str, until: int) -> None:
        self.rules.updateValue((rule,), (pattern, until))
        self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        own = pd.concat(list(rows))
        own = own.assign(_o=own["event"].map(ORDER)).sort_values(["at", "_o"], kind="stable")
        for r in own.itertuples():
            now = int(pd.Timestamp(r.at).timestamp() * 1000)
            if r.event == "rule":
                self._keep(r.rule_id, r.pattern, now + self.idle)
            elif r.event == "remove":
                if self.rules.containsKey((r.rule_id,)):
                    self.rules.removeKey((r.rule_id,))
            else:
                for (rule,), (pattern, until) in sorted(self.rules.iterator()):
                    if until > now:
                        out.append((key[0], "applied", rule, r.doc_id, pattern, r.at))
                        self._keep(rule, pattern, max(until, now + self.idle))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (rule,), (pattern, until) in sorted(self.rules.iterator()):
            if until <= now:
                self.rules.removeKey((rule,))
                out.append((key[0], "ended", rule, None, pattern, pd.Timestamp(until, unit="ms")))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["owner", "event", "rule_id", "doc_id", "pattern", "at"])
    return df.astype({"doc_id": "Int64"}).assign(at=pd.to_datetime(df["at"]))


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs RocksDB: set it before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def owner_rule_stream(events: DataFrame, idle_ms: int = IDLE_MS, late: str = "0 seconds") -> DataFrame:
    """owner, event (applied or ended), rule_id, doc_id, pattern, at for a stream of events (owner, event: rule, remove or
    document, rule_id, pattern, doc_id, at)."""
    own = events.select("owner", "event", "rule_id", "pattern", "doc_id", "at").withWatermark("at", late)
    return own.groupBy("owner").transformWithStateInPandas(OwnerRules(idle_ms), OUT, "Append", "EventTime")
