"""Vector search for many queries: exact in blocks, and by an inverted file of k-means cells.

Neither collects queries or vectors.  Both deal vectors and queries into parts of bounded size that meet part by part, in
one matrix product each: every part with every block of queries where the search is exact, the parts of a cell with the
queries that look into it where it goes by cells.  A cell that holds a third of all vectors is many parts.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.operators.retrieval import ranked
from docgrid.operators.staging import cut
from docgrid.session import Warehouse

PART = 20_000  # vectors that meet a block of queries at a time
BLOCK = 2_000  # queries of a block
CELLS_AT_ONCE = 1 << 21  # of a product that is in memory
SAMPLE = 200_000  # vectors from which centres are learned, those of the least hashes
CELLS = 4_096  # most cells
ROUNDS = 8
RECALL, ASKED, NEAR = 0.96, 200, 50  # how many cells a search looks into is measured: share of the neighbours, questions, neighbours of each


def usable(vectors: DataFrame, key: str, vector: str, size: int | None = None) -> DataFrame:
    """(key, v) of the vectors that have a direction: neither null nor of another size, without null or infinite parts."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).alias("key"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    return rows if size is None else rows.filter(F.size("v") == size)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _nearest(top_k: int, schema: pa.Schema):
    """The ``top_k`` nearest of a part's vectors to each query of a block, and those that rounding ties with the last."""

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        v, q = _matrix(vectors.column("v")).T, _matrix(queries.column("q"))
        place = np.empty(vectors.num_rows, np.int64)
        place[pc.sort_indices(vectors.column("key")).to_numpy()] = np.arange(len(place))
        found = []
        # a few queries at a time, so that no product has more than CELLS_AT_ONCE cells
        step = max(1, CELLS_AT_ONCE // len(place))
        for begin in range(0, len(q), step):
            near = q[begin : begin + step] @ v
            if near.shape[1] > top_k:
                edge = np.partition(near, -top_k, axis=1)[:, -top_k]
                of, at = np.nonzero(near >= edge[:, None] - 2e-6)
            else:
                of, at = (x.ravel() for x in np.indices(near.shape))
            said = near[of, at]
            if len(of) > 2 * top_k * len(near):
                # of copies, which are equal but for the last digits, those of the smallest keys
                level = np.rint(said * 1e12).astype(np.int64)
                order = np.lexsort((place[at], -level, of))
                of, at, said, level = of[order], at[order], said[order], level[order]
                first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (level[1:] != level[:-1]))))
                kept = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of)))) < top_k
                of, at, said = of[kept], at[kept], said[kept]
            found.append((of + begin, at, said))
        of, at, said = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([queries.column("query_id").take(pa.array(of)), vectors.column("key").take(pa.array(at)), pa.array(said)], schema=schema)

    return meet


def _meet(vectors: DataFrame, queries: DataFrame, on: list[str], top_k: int, key: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    out = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("key", vectors.schema["key"].dataType), StructField("similarity", DoubleType())])
    near = vectors.groupBy(*on).cogroup(queries.groupBy(*on)).applyInArrow(_nearest(top_k, to_arrow_schema(out)), out)
    near = near.select("query_id", F.col("key").alias(key), (F.round("similarity", 6) + F.lit(0.0)).alias("similarity"))
    return ranked(near, key, "similarity", "vector_rank", top_k, ["query_id"])


def _dealt(rows: DataFrame, n: int, most: int, name: str, by: str) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64(by), F.lit(max(1, ceil(n / most)))).cast("int"))


def search_exact(vectors: DataFrame, queries: DataFrame, top_k: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, similarity, vector_rank): the nearest vectors of every query (query_id, query_vector), exactly.

    Vectors that are null, or of another size than a query, aren't compared with it.  The work is queries times vectors,
    and every part of ``PART`` vectors is sent once for each block of ``BLOCK`` queries.
    """
    v, q = usable(vectors, key, vector), usable(queries, "query_id", "query_vector").withColumnsRenamed({"key": "query_id", "v": "q"})
    n, m = v.count(), q.count()
    parts, blocks = max(1, ceil(n / PART)), max(1, ceil(m / BLOCK))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    v = _dealt(v, n, PART, "part", "key").withColumn("block", every(blocks)).withColumn("size", F.size("v"))
    q = _dealt(q, m, BLOCK, "block", "query_id").withColumn("part", every(parts)).withColumn("size", F.size("q"))
    return _meet(v, q, ["part", "block", "size"], top_k, key)


def _assign(centres: np.ndarray, probes: int = 1):
    """The nearest centres of each vector, nearest first."""

    def run(batches):
        for b in batches:
            m = _matrix(b.column(1))
            near = m @ centres.T
            at = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1]), pa.int32()), pa.array(at.ravel()))], ["key", "v", "cells"])

    return run


def assigned(rows: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """``rows`` (key, v) with the numbers of their nearest cells."""
    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "v").mapInArrow(_assign(centres, min(probes, len(centres))), f"key {kind}, v array<double>, cells array<int>")


def train(rows: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``cells`` cells by spherical k-means over ``rows`` (key, v).

    A round adds up the vectors of each cell on executors; the driver gets the centres only.  The first are the rows of
    the least hashes; a cell that no vector is nearest to keeps its centre.
    """
    by = F.xxhash64("key", "v")
    first = rows.orderBy(by).limit(cells).select("v").collect()
    centres = np.array([r[0] for r in first], np.float64)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    for _ in range(rounds):

        def run(batches, centres=centres):
            total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for b in batches:
                m = _matrix(b.column(0))
                at = np.argmax(m @ centres.T, axis=1)
                np.add.at(total, at, m)
                count += np.bincount(at, minlength=len(centres))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["cell", "total"])

        parts = rows.select("v").mapInArrow(run, "cell int, total array<double>")
        sums = parts.select("cell", F.posexplode("total")).groupBy("cell", "pos").agg(F.sum("col").alias("x")).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("pos", "x")))["x"].alias("total"))
        new = centres.copy()
        for r in sums.collect():
            v = np.array(r["total"])
            new[r["cell"]] = v / max(np.linalg.norm(v), 1e-300)
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres


class InvertedFile:
    """Vectors stored by cell (a folder a cell), and the cells' centres."""

    def __init__(self, warehouse: Warehouse, name: str = "ivf"):
        self.w, self.spark, self.name = warehouse, warehouse.spark, name

    @property
    def _data(self) -> str:
        return f"{self.w.root}/{self.name}_cells/data"

    def build(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> int:
        """Learn the cells from ``SAMPLE`` vectors at most, store all vectors by cell, and return how many cells there are.

        Vectors must be of one size, the most frequent; null ones and those of another size are left out.
        """
        sizes = usable(vectors, key, vector).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
        if sizes is None:
            raise ValueError("there is no vector")
        rows = usable(vectors, key, vector, sizes["size"])
        n = sizes["count"]
        share = min(1.0, 1.1 * SAMPLE / n)
        sample = cut(rows.filter(F.xxhash64("key") <= int((1 << 64) * share) - (1 << 63) - 1).orderBy(F.xxhash64("key")).limit(SAMPLE) if share < 1 else rows)
        centres = train(sample, min(cells or ceil(sqrt(n)), CELLS, n))
        probes = self._measured(sample, centres)
        told = self.spark.createDataFrame([(i, [float(x) for x in c], key, probes) for i, c in enumerate(centres)], "cell int, centre array<double>, key string, probes int")
        placed = assigned(rows, centres).select("key", "v", F.col("cells")[0].alias("cell"))
        # few files a cell: hot cells get several by the hash of the key
        placed.withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(4))).repartition("cell", "deal").drop("deal").write.mode("overwrite").partitionBy("cell").parquet(self._data)
        self.w.write(f"{self.name}_centres", told)
        return len(centres)

    def _measured(self, sample: DataFrame, centres: np.ndarray) -> int:
        """How many of the nearest cells hold ``RECALL`` of the ``NEAR`` nearest vectors of ``ASKED`` vectors of the sample.

        Vectors in clear groups need few cells, and such without any nearly all of them.
        """
        asked = cut(sample.orderBy(F.xxhash64("key", F.lit("asked"))).limit(ASKED).select("key", "v"))
        near = search_exact(sample, asked.select(F.col("key").alias("query_id"), F.col("v").alias("query_vector")), NEAR + 1, "key", "v").filter("key <> query_id")
        cell = assigned(sample, centres).select("key", F.col("cells")[0].alias("cell"))
        order = assigned(asked, centres, len(centres)).select(F.col("key").alias("query_id"), "cells")
        place = near.join(cell, "key").join(order, "query_id").select(F.array_position("cells", F.col("cell")).alias("place"))
        return int(place.agg(F.percentile("place", RECALL)).first()[0] or 0) + 1

    def centres(self) -> tuple[np.ndarray, str, int]:
        rows = self.w.read(f"{self.name}_centres").orderBy("cell").collect()
        return np.array([r["centre"] for r in rows]), rows[0]["key"], rows[0]["probes"]

    def search(self, queries: DataFrame, top_k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, key, similarity, vector_rank) of the nearest vectors in each query's ``probes`` nearest cells, by default
        as many as were measured when the index was built.

        Only the folders of cells that a query looks into are read.
        """
        centres, key, measured = self.centres()
        probes = probes or measured
        q = usable(queries, "query_id", "query_vector", centres.shape[1])
        looks = cut(assigned(q, centres, probes).select(F.col("key").alias("query_id"), F.col("v").alias("q"), F.explode("cells").alias("cell")))
        wanted = [r[0] for r in looks.select("cell").distinct().collect()]  # cells at most
        v = self.spark.read.parquet(self._data).filter(F.col("cell").isin(wanted))
        size = v.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        asks = looks.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        deal = cut(size.join(asks, "cell"))  # a row a cell
        at = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
        v = v.join(F.broadcast(deal), "cell").withColumn("part", at("key", "parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        looks = looks.join(F.broadcast(deal), "cell").withColumn("block", at("query_id", "blocks")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        on = ["cell", "part", "block"]
        return _meet(v.select(*on, "key", "v"), looks.select(*on, "query_id", "q"), on, top_k, key)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> float:
    """The share of the exact results that were found."""
    n = exact.count()
    return exact.join(found.select("query_id", key), ["query_id", key], "left_semi").count() / n if n else 1.0
