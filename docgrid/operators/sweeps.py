"""Overlapping intervals by a sweep over their starts.

Intervals are dealt into slices of neighbouring starts, so a family of any size is many tasks.  An interval also goes to
the later slices in which one may begin before it ends; there it meets starts only that lie before its end.  So what is
met overlaps, and intervals that don't overlap anything cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.operators.staging import cut

SLICE = 50_000  # intervals of a slice, about
FOREVER = (1 << 63) - 1
EMIT = 1 << 16


def _last_slices(bounds: dict):
    """The slices of a family that begin before an interval ends: from its own on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pid, end = b.column("pid").to_numpy(), b.column("e").to_numpy()
            last = pid.copy()
            for k, f in enumerate(b.column("f").to_pylist()):
                if f in bounds:
                    pids, firsts = bounds[f]
                    last[k] = max(pid[k], pids[max(np.searchsorted(firsts, end[k]) - 1, 0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(last)], names=[*b.schema.names, "last"])

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (f, slice, later, s, e, id) in the order of family, slice, later, start; those that begin in the slice come first."""
    where, starts, ends, ids = None, [], [], []
    ready = None

    def pairs(s, e, own: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
        # each of (s, e, own) with the starts of the slice from `low` on that lie before its end
        high = np.maximum(np.searchsorted(ready[0], e, "left"), low)
        for a in range(0, len(s)):
            for at in range(low[a], high[a], EMIT):
                to = np.arange(at, min(high[a], at + EMIT))
                to = to[ready[1][to] > s[a]]
                if len(to):
                    yield pa.RecordBatch.from_arrays([pa.array([where[0]] * len(to), kinds[0]), pa.array([own[a]] * len(to), kinds[1]), pa.array(ready[2][to], kinds[1])], names=["f", "x", "y"])

    kinds = None
    for b in batches:
        kinds = (b.column("f").type, b.column("id").type)
        keys = list(zip(b.column("f").to_pylist(), b.column("slice").to_pylist(), strict=True))
        later = b.column("later").to_pylist()
        s, e, own = b.column("s").to_numpy(), b.column("e").to_numpy(), np.array(b.column("id").to_pylist(), dtype=object)
        k = 0
        while k < len(keys):
            end = k
            while end < len(keys) and keys[end] == keys[k] and later[end] == later[k]:
                end += 1
            if keys[k] != where:
                if where is not None and ready is None and starts:
                    ready = (np.concatenate(starts), np.concatenate(ends), np.concatenate(ids))
                    yield from pairs(ready[0], ready[1], ready[2], np.arange(1, len(ready[0]) + 1))
                where, starts, ends, ids, ready = keys[k], [], [], [], None
            if not later[k]:
                starts.append(s[k:end])
                ends.append(e[k:end])
                ids.append(own[k:end])
            else:
                if ready is None:
                    ready = tuple(np.concatenate(x) for x in (starts, ends, ids)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object))
                    yield from pairs(ready[0], ready[1], ready[2], np.arange(1, len(ready[0]) + 1))
                yield from pairs(s[k:end], e[k:end], own[k:end], np.zeros(end - k, np.int64))
            k = end
    if where is not None and ready is None and starts:
        ready = (np.concatenate(starts), np.concatenate(ends), np.concatenate(ids))
        yield from pairs(ready[0], ready[1], ready[2], np.arange(1, len(ready[0]) + 1))


def overlaps(rows: DataFrame, family: str, key: str, start: str, end: str, size: int | None = None) -> DataFrame:
    """family, left_id, right_id: pairs of a family's intervals [start, end) that overlap, each once, the smaller key left.

    A null start is no interval, a null end never ends, a null family is none.  Starts are days, times or whole numbers.
    """
    number = {"date": F.unix_date, "timestamp": F.unix_micros}.get(rows.schema[start].dataType.typeName(), lambda c: c)
    r = rows.filter(F.col(start).isNotNull() & F.col(family).isNotNull())
    r = r.select(F.col(family).alias("f"), F.col(key).alias("id"), number(F.col(start)).cast("long").alias("s"), F.coalesce(number(F.col(end)).cast("long"), F.lit(FOREVER)).alias("e"))
    n = r.count() // (size or SLICE) + 1
    r = cut(r.repartitionByRange(n, "f", "s", "id").withColumn("pid", F.spark_partition_id()))
    slices = r.groupBy("f", "pid").agg(F.min("s").alias("first"))
    # families in several slices are at most as many as there are slices
    spread = slices.groupBy("f").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("pid", "first"))).alias("slices")).filter("n > 1")
    bounds = {x["f"]: ([p["pid"] for p in x["slices"]], np.array([p["first"] for p in x["slices"]])) for x in spread.collect()}
    kinds = {c: r.schema[c].dataType.simpleString() for c in ("f", "id")}
    placed = r.select("f", "id", "s", "e", "pid").mapInArrow(_last_slices(bounds), f"f {kinds['f']}, id {kinds['id']}, s long, e long, pid int, last int")
    placed = placed.withColumn("slice", F.explode(F.sequence("pid", "last"))).withColumn("later", F.col("slice") > F.col("pid"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select("f", "slice", "later", "s", "e", "id").repartition(max(parts, n), "f", "slice").sortWithinPartitions("f", "slice", "later", "s")
    met = dealt.mapInArrow(_sweep, f"f {kinds['f']}, x {kinds['id']}, y {kinds['id']}").filter("x <> y")
    return met.select(F.col("f").alias(family), F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"))
