"""Where models plug in: embeddings, semantic reranking with validation and a content-keyed cache, index texts.

Without a provider everything works offline: vectors come from hashed tokens, reranking keeps the fused order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.functions.text import is_blank

from .retrieval import tokens

CANDIDATES = 30
TOKENS = 1 << 20  # of the rows that are looked at together


def index_text(*parts: Column) -> Column:
    """The parts that aren't blank, a line each."""
    return F.array_join(F.filter(F.array(*parts), lambda p: ~is_blank(p)), "\n")


def assertion_text(subject: Column, predicate: Column, obj: Column, receiver: Column, qualifiers: Column) -> Column:
    """What is searched of an assertion: its parties, what is done, and its qualifiers, in one line."""
    return F.array_join(F.filter(F.concat(F.array(subject, predicate, obj, receiver), F.coalesce(qualifiers, F.array().cast("array<string>"))), lambda p: ~is_blank(p)), " ")


def hashed_vectors(rows: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """key and a unit vector of signed token hashes: a substitute for a model, the same everywhere."""
    kind = rows.schema[key].dataType.simpleString()
    # what Python gets of a token is its place and sign in one short number
    cell = lambda h: (F.pmod(h, F.lit(dim)) * 2 + F.shiftright(h, 40).bitwiseAND(F.lit(1))).cast("smallint" if dim < 1 << 14 else "int")
    hashed = rows.select(key, F.transform(tokens(F.col(text)), lambda t: cell(F.xxhash64(t))).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # rows of one batch by the thousand, fewer where they have more tokens
            ends = whole.column(1).offsets.to_numpy().astype(np.int64)
            begin = 0
            while begin < whole.num_rows:
                end = min(whole.num_rows, begin + 1000, max(begin + 1, int(np.searchsorted(ends, ends[begin] + TOKENS, "right")) - 1))
                h = whole.column(1).values.slice(ends[begin], ends[end] - ends[begin]).to_numpy()
                place = np.repeat(np.arange(end - begin), np.diff(ends[begin : end + 1]))
                out = np.bincount(place * (2 * dim) + h, minlength=2 * dim * (end - begin)).reshape(end - begin, dim, 2)
                out = (out[:, :, 1] - out[:, :, 0]).astype(np.float64)
                out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim), pa.int32()), pa.array(out.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(begin, end - begin), vectors], [key, "embedding"])
                begin = end

    return hashed.mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


def embed(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """key and the model's normalised vector; vectors of another length raise ValueError."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(model([t or "" for t in b.column(1).to_pylist()]), np.float64)
            if v.shape != (b.num_rows, dim):
                raise ValueError(f"the model gave {v.shape}, not {(b.num_rows, dim)}")
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))], [key, "embedding"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


def semantic_rerank(candidates: DataFrame, question: str, score: Callable[[str, list[str]], list[float]], key: str = "clause_id", text: str = "search_text", limit: int = CANDIDATES) -> DataFrame:
    """The first ``limit`` candidates by ``rank`` with the model's scores (0 to 1) and in their order.

    If the model fails or gives anything but a score for each, the order stays; reranked tells which.
    """
    first = candidates.orderBy("rank").limit(limit)
    rows = first.select(key, text).collect()
    try:
        got = [float(s) for s in score(question, [r[1] for r in rows])]
        if len(got) != len(rows) or not all(0 <= s <= 1 for s in got):
            raise ValueError("a score from 0 to 1 for each candidate is needed")
    except Exception:  # noqa: BLE001 - a provider may fail in any way, and the search must answer all the same
        return first.withColumn("semantic_score", F.lit(None).cast("double")).withColumn("reranked", F.lit(False))
    kind = candidates.schema[key].dataType.simpleString()
    scores = candidates.sparkSession.createDataFrame([(r[0], s) for r, s in zip(rows, got, strict=True)], f"`{key}` {kind}, semantic_score double")
    return first.join(F.broadcast(scores), key).withColumn("reranked", F.lit(True)).orderBy(F.desc("semantic_score"), "rank")


def cache_key(question: Column, text: Column, version: str) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(version), question, text), 256)


def cached_scores(candidates: DataFrame, cache: DataFrame, question: str, now: Column, ttl_seconds: int = 600, version: str = "v1", text: str = "search_text") -> DataFrame:
    """Candidates with the cached score of their question and text, null where there is none that is young enough."""
    fresh = cache.filter(F.unix_timestamp(now) - F.unix_timestamp("cached_at") <= ttl_seconds)
    last = fresh.groupBy("cache_key").agg(F.max_by("score", "cached_at").alias("cached_score"))
    return candidates.withColumn("cache_key", cache_key(F.lit(question), F.col(text), version)).join(last, "cache_key", "left")


CACHED = 256


def merged_cache(cache: DataFrame, uses: DataFrame, generation: int, now: Column, ttl_seconds: int = 600, most: int = CACHED) -> DataFrame:
    """The cache (cache_key, score, cached_at, last_used, generation) after ``uses`` (cache_key, score, used_at, generation).

    A use with a score stores it, one without only reads it.  Entries of another generation, without a score, or older than
    ``ttl_seconds`` leave; of the others the ``most`` last used stay, ties going to the smaller key.  Of stores at one
    time the larger score counts, and a null key is no entry.
    """
    told = uses.select("cache_key", F.col("score").cast("double").alias("score"), F.when(F.col("score").isNotNull(), F.col("used_at")).alias("cached_at"), F.col("used_at").alias("last_used"), "generation")
    rows = cache.select("cache_key", F.col("score").cast("double").alias("score"), "cached_at", "last_used", "generation").unionByName(told).filter((F.col("generation") == generation) & F.col("cache_key").isNotNull())
    one = rows.groupBy("cache_key").agg(F.max(F.when(F.col("score").isNotNull(), F.struct("cached_at", "score"))).alias("s"), F.max("last_used").alias("last_used"))
    one = one.select("cache_key", F.col("s.score").alias("score"), F.col("s.cached_at").alias("cached_at"), "last_used", F.lit(generation).alias("generation"))
    young = one.filter(F.col("score").isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp("cached_at") <= ttl_seconds))
    return young.orderBy(F.desc("last_used"), "cache_key").limit(most)
