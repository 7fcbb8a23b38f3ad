"""Keyed state with timers against the ledger's own transitions on a replayed stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from docgrid.operators import ledger
from docgrid.streaming import retries

BATCHES = [
    [("a", "submitted", 0, None), ("b", "submitted", 0, None), ("c", "submitted", 0, None), ("d", "submitted", 0, None), ("x", "started", 0, None)],
    [("a", "started", 1, None), ("b", "started", 1, None), ("c", "started", 1, None), ("d", "started", 1, None)],
    [("a", "succeeded", 2, None), ("b", "failed", 2, "HTTP 503"), ("c", "failed", 2, "bad file"), ("a", "failed", 3, "too late")],
    [("b", "started", 3, None)],  # before its time
    [("b", "started", 5, None), ("b", "failed", 6, "timed out")],
    [("b", "started", 20, None), ("b", "failed", 21, "connection refused")],
    [("d", "heartbeat", 1000, None)],
    [("z", "submitted", 2500, None)],
    [("z", "started", 4000, None)],
    [("d", "started", 4100, None), ("d", "succeeded", 4200, None)],
]


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    retries.use_state_store(spark)
    yield
    spark.conf.set(name, before)


def test_replayed_stream(spark, store, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    src.mkdir()
    told = []
    for n, batch in enumerate(BATCHES):
        with open(src / f"{n:02d}.json", "w") as f:
            f.write("\n".join(json.dumps({"item_id": i, "kind": k, "at": f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}", "error": e}) for i, k, s, e in batch))
        os.utime(src / f"{n:02d}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken in the order of their times

    def keep(rows, number):
        told.extend(rows.select("item_id", F.unix_timestamp("at").alias("at"), "status", "attempt_count", "error_kind", F.unix_timestamp("next_retry_at").alias("due")).collect())

    def run():
        events = spark.readStream.schema("item_id string, kind string, at timestamp, error string").option("maxFilesPerTrigger", 1).json(str(src))
        query = retries.attempts(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(mark)).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    zero = 1704067200
    got = {}
    for r in sorted(told, key=lambda r: r["at"]):
        got.setdefault(r["item_id"], []).append((r["at"] - zero, r["status"], r["attempt_count"], r["error_kind"], r["due"] and r["due"] - zero))
    assert got["a"] == [(0, "pending", 0, None, None), (1, "running", 0, None, None), (2, "succeeded", 1, None, None)]
    assert got["c"][-1] == (2, "failed", 1, "permanent", None) and "x" not in got
    assert [g for g in got["b"] if g[1] != "retry_due"] == [
        (0, "pending", 0, None, None), (1, "running", 0, None, None), (2, "retry_wait", 1, "transient", 4), (5, "running", 1, "transient", None), (6, "retry_wait", 2, "transient", 10),
        (20, "running", 2, "transient", None), (21, "failed", 3, "transient", None),
    ]
    assert [g[1] for g in got["d"]] == ["pending", "running", "stale", "running", "succeeded"] and got["d"][2][0] >= 1000 + ledger.STALE_SECONDS
    # each failure is what the ledger makes of the same attempt
    tries = [("b", 0, "HTTP 503", 2), ("b", 1, "timed out", 6), ("b", 2, "connection refused", 21), ("c", 0, "bad file", 2)]
    items = spark.createDataFrame(tries, "id string, attempt_count int, error string, s int").withColumn("ok", F.lit(False))
    for r in ledger.after_attempt(items, F.timestamp_seconds(F.lit(zero) + F.col("s"))).withColumn("due", F.unix_timestamp("new_retry_at")).collect():
        assert (r["s"], r["new_status"], r["new_attempt_count"], r["new_error_kind"], r["due"] and r["due"] - zero) in got[r["id"]]
    # a query that starts again goes on behind its checkpoint
    seen = len(told)
    run()
    assert len(told) == seen
