"""Shared helpers: table access, shared-storage staging, held-out split, Arrow batch mapping."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


READ_PARTITIONS = "spark.docgrid.readPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``, read by Spark whatever the file system.

    Where the session sets ``spark.docgrid.readPartitions``, tables of texts are dealt over so many partitions: for a
    caller whose table is one row group, of which a scan can make one task only.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    asked = spark.conf.get(READ_PARTITIONS, "")
    return df.repartition(int(asked)) if asked and name in ("documents", "pages") else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Where the session names none a temporary folder is set as the checkpoint folder, if driver and executors are one
    machine; on a cluster without such a folder RuntimeError is raised.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="docgrid-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - best effort at interpreter exit, when the JVM may be gone
        return


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are removed at the end, but for those staged with ``kept``.

    For operators that go through many tables to a small one, on which alone their result depends.
    """
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        for path in _open.paths:
            _remove(spark, path)
        _open.paths = outer


def observed(df: DataFrame, tag: str, **what: Column) -> tuple[DataFrame, dict]:
    """``staged`` with the values of aggregations that are taken along while it is written."""
    seen = Observation()
    out = staged(df.observe(seen, *[c.alias(n) for n, c in what.items()]), tag)
    return out, seen.get


def staged(df: DataFrame, tag: str, kept: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    The table goes with the ``scratch`` around it, unless it is ``kept``, and at the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docgrid-{tag}-{uuid.uuid4().hex}"
    if not kept and getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    else:
        atexit.register(_remove, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_KEYS = 1_000_000


def limited(keys: DataFrame, most: int | None = None) -> DataFrame:
    """``keys`` marked for broadcasting if they are at most ``most`` (``BROADCAST_KEYS``); they are counted for that."""
    return F.broadcast(keys) if keys.count() <= (most or BROADCAST_KEYS) else keys


def packed(columns: list[str]) -> Column:
    """Columns as one struct, so that none of their names can meet one of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def unpacked(rec: str, columns: list[str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of such a struct, but for those named like one of ``without`` in whatever case."""
    gone = {n.lower() for n in without}
    return [F.col(rec).getField(c).alias(c) for c in columns if c.lower() not in gone]


def numbered(docs: DataFrame, tag: str, columns: list[str], **more: Column) -> DataFrame:
    """Staged rows (rid, rec, more): rid is a number of the stored row, rec its ``columns`` packed.

    The numbers are written with the rows, so they stay the same whatever is computed again, and equal rows, which
    nothing else tells apart, can be counted and dealt out one by one.
    """
    return staged(docs.select(F.monotonically_increasing_id().alias("rid"), packed(columns).alias("rec"), *[c.alias(n) for n, c in more.items()]), tag)


SALTS = 64


def occurrences(meta: DataFrame, identity: str, tag: str) -> DataFrame:
    """Staged ``meta`` (with rid) and occ: 1, 2, ... among the rows that are equal in ``identity``.

    A group of equal rows is counted in ``SALTS`` parts, so that no task gets more than such a part of it.
    """
    rows = meta.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    counts = rows.groupBy(identity, "salt").agg(F.count("*").alias("n"))
    left = Window.partitionBy(identity).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.sum("n").over(left)).filter("start > 0").select(identity, "salt", "start")
    within = F.row_number().over(Window.partitionBy(identity, "salt").orderBy("rid"))
    out = rows.withColumn("within", within).join(starts, [identity, "salt"], "left")
    return staged(out.select(*meta.columns, (F.col("within") + F.coalesce("start", F.lit(0))).cast("long").alias("occ")), tag)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves 1 modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def hash_limit(rows: float, of: int) -> int:
    """The signed 64-bit hash up to which ``rows`` of ``of`` rows are expected to lie."""
    return min((1 << 63) - 1, int((1 << 64) * min(1.0, rows / max(of, 1))) - (1 << 63))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, raw: tuple[str, ...] = ()) -> DataFrame:
    """Apply a column-wise function to Arrow batches.

    ``make`` runs once per task and returns a function from input columns (name to list; those in ``raw`` as Arrow
    arrays) to output columns.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in split_batch(batch):
                done = apply({n: part.column(i) if n in raw else part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([done[f.name].cast(f.type) if isinstance(done[f.name], pa.Array) else pa.array(done[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def split_batch(batch: pa.RecordBatch, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most_bytes`` each (at least one row), so that long texts bound no memory."""
    rows = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
