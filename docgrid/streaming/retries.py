"""Attempts on items as keyed state with timers: back-off, staleness and the end of retries.

A stream of events (item_id, kind, at, error) drives one small state per item: ``submitted``, ``started``, ``heartbeat``,
``succeeded`` or ``failed``.  A transient failure sets a timer at the time of its retry, and a running item one at the
time by which its heartbeat is stale; what a timer finds is told as a row, like every change of an event.  Timers follow
the events' own time, so a replayed stream gives the same states.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docgrid.operators.ledger import BACKOFF_SECONDS, MAX_ATTEMPTS, RETRYABLE, STALE_SECONDS

STATE = "status string, attempts int, error_kind string, due_ms long, last_ms long"
OUT = "item_id string, at timestamp, status string, attempt_count int, error_kind string, next_retry_at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(at: pd.Timestamp) -> int:
    """Milliseconds; a time without a zone is one of UTC."""
    return int(at.timestamp() * 1000) if at.tzinfo else int(at.tz_localize("UTC").timestamp() * 1000)


class Attempts(StatefulProcessor):
    """The state of one item; ``max_attempts`` and ``stale`` as in ``ledger``."""

    def __init__(self, max_attempts: int = MAX_ATTEMPTS, stale: int = STALE_SECONDS):
        self.max_attempts, self.stale = max_attempts, stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", STATE)

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def _row(self, key: str, at: int, status: str, attempts: int, kind: str | None, due: int | None) -> tuple:
        when = lambda ms: None if ms is None else pd.Timestamp(datetime.fromtimestamp(ms / 1000, timezone.utc)).tz_localize(None)
        return key, when(at), status, attempts, kind, when(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, kind, due, last = self.state.get() if self.state.exists() else (None, 0, None, None, 0)
        events = pd.concat(list(rows)).sort_values(["at", "kind"], kind="stable")
        out = []
        for what, time, error in zip(events["kind"], events["at"], events["error"], strict=True):
            at = _ms(pd.Timestamp(time))
            if status == "running" and at >= due:  # its timer is due by the event's own time
                out.append(self._row(key[0], due, "stale", attempts, kind, None))
                status = "stale"
            if status in ("succeeded", "failed") or (status is None and what != "submitted"):
                continue  # the item has ended, or nobody asked for it
            if what == "submitted" and status is None:
                status, due = "pending", None
            elif what == "started" and (status in ("pending", "stale") or (status == "retry_wait" and at >= due)):
                status, due = "running", at + self.stale * 1000
            elif what == "heartbeat" and status == "running":
                due = at + self.stale * 1000
                continue
            elif what == "succeeded" and status == "running":
                status, kind, due, attempts = "succeeded", None, None, attempts + 1
            elif what == "failed" and status == "running":
                attempts += 1
                kind = "transient" if re.search(RETRYABLE, (error or "").lower()) else "permanent"
                again = kind == "transient" and attempts < self.max_attempts
                # as the ledger does, a retry is due at a whole second
                due = (at // 1000 + BACKOFF_SECONDS[min(attempts, len(BACKOFF_SECONDS)) - 1]) * 1000 if again else None
                status = "retry_wait" if again else "failed"
            else:
                continue
            last = max(last, at)
            out.append(self._row(key[0], at, status, attempts, kind, due if status == "retry_wait" else None))
        if status is not None:
            self.state.update((status, attempts, kind, due, last))
            self._timer(due if status in ("running", "retry_wait") else None)
        if out:
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in OUT.split(",")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, kind, due, last = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if status == "running" and due is not None and at >= due:
            status = "stale"
        elif status != "retry_wait":
            return
        self.state.update((status, attempts, kind, due, last))
        told = "retry_due" if status == "retry_wait" else status
        yield pd.DataFrame([self._row(key[0], at, told, attempts, kind, None)], columns=[c.strip().split(" ")[0] for c in OUT.split(",")])

    def close(self) -> None:
        """The store belongs to Spark."""


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs Spark's RocksDB store; a session that has another keeps it for its other queries."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def attempts(events: DataFrame, late: str = "0 seconds", max_attempts: int = MAX_ATTEMPTS, stale: int = STALE_SECONDS) -> DataFrame:
    """Every change of every item: item_id, at, status, attempt_count, error_kind, next_retry_at.

    Besides the ledger's statuses there are ``retry_due`` and ``stale``, which timers tell.  ``late`` is how much later than
    newer events one may come.  Events of an item in one batch are taken by time; unknown kinds, and events that don't
    fit the item's status, change nothing.
    """
    e = events.select(F.col("item_id").cast("string").alias("item_id"), "kind", F.col("at").cast("timestamp").alias("at"), "error").filter("item_id IS NOT NULL AND at IS NOT NULL")
    return e.withWatermark("at", late).groupBy("item_id").transformWithStateInPandas(Attempts(max_attempts, stale), OUT, "Update", "EventTime")
