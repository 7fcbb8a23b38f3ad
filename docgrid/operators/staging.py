"""Cutting lineage through the storage that all executors share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Without one a temporary folder is set where driver and executors are one machine; on a cluster RuntimeError is raised.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docgrid-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def pack(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def packed(df: DataFrame) -> DataFrame:
    """(rows): ``df`` checkpointed as compressed batches, since Spark's checkpoints aren't compressed; ``unpacked`` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pack(b)], pa.binary())], ["rows"])

    return cut(df.mapInArrow(run, "rows binary"))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of rows that ``pack`` made."""
    for b in batches:
        for rows in b.column(0):
            with pa.ipc.open_stream(rows.as_buffer()) as stream:
                yield from stream


#: Tasks for each core among which rows are dealt.
TASKS = 3


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt over all cores by ``by``, or its first column, before work that takes far longer than the shuffle."""
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, *(by or df.columns[:1]))
