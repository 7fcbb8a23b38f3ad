"""Resumable ingestion: files arriving in a folder become items of a ledger, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.functions import ids


def ingest(spark: SparkSession, folder: str, warehouse: str, process: Callable[[DataFrame], DataFrame]) -> int:
    """Take all files that arrived since the last call and append what ``process`` makes of new contents.

    ``process`` gets path, file_hash and content and returns rows with file_hash.  Progress is kept in the warehouse's
    checkpoint, and each micro-batch overwrites its own partition, so an interrupted call can be repeated.  Returns the
    number of rows in the result.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        # the first path of each content is found on hashes alone; contents aren't dealt out for that
        first = batch.select("path", ids.file_hash(F.col("content")).alias("file_hash")).groupBy("file_hash").agg(F.min(F.struct(F.lower("path").alias("lower"), "path"))["path"].alias("path"))
        new = batch.join(first, "path")
        done = known(batch.sparkSession, warehouse, number)
        if done is not None:
            new = new.join(done, "file_hash", "left_anti")
        process(new.select("path", "file_hash", "content")).write.mode("overwrite").parquet(f"{warehouse}/items/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{warehouse}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = known(spark, warehouse, None)
    return 0 if rows is None else rows.count()


def known(spark: SparkSession, warehouse: str, before: int | None) -> DataFrame | None:
    """Hashes of the contents in the ledger, of batches before ``before``; None where there is no ledger yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{warehouse}/items")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.parquet(f"{warehouse}/items")
    return (rows if before is None else rows.filter(F.col("batch") < before)).select("file_hash")


def event_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Counts by type and time window, for streams and tables alike; late rows are taken until the watermark passes."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
