"""Substring dedup: words under a window of ``WINDOW`` words that starts anywhere else as well are removed.

A count-min sketch goes first.  Each window is filed under one of its grams of ``GRAM`` words, the one of least hash, so
equal windows at two places are filed under one gram at two places, and how often a gram is filed is never less than how
often a window under it occurs.  Neighbouring windows share their gram: one word in six or seven has a gram that is
filed.  Every partition counts grams in two rows of cells, the cells are merged by slice, and what tasks get is one bit a
cell: counted twice or more.  The sketch has a fixed size, a parameter; where a corpus fills it, more windows go on.

The second pass groups the windows that may be repeated by 128 bits of hash, exactly: each that is alone is given back
to its document, and all others are repeated.  The third pass removes the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, scratch, split_batch, staged, unpacked

WINDOW, GRAM = 35, 24
CELLS = 1 << 27  # of each of the two rows of the sketch: 32 MB of bits altogether
SLICE = 1 << 20
PIECE = 1 << 20  # words of a text that are hashed at a time
FULL = 1 << 22  # cells counted before a task gives them away
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Words:
    """Words of a batch of texts: ``flat``, the number of each text's, and 128 bits of hash of each."""

    def __init__(self, texts: pa.Array, hashed: bool = True):
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # space and \x09-\x0D
        flat, bounds = split.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))
        there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        self.flat = flat.filter(pa.array(there))
        self.bounds = np.concatenate(([0], np.cumsum(there)))[bounds].astype(np.int64)
        self.counts = np.diff(self.bounds)
        if hashed:
            coded = self.flat.dictionary_encode()
            known = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64).reshape(-1, 2)
            self.hash = known[coded.indices.to_numpy()]


def rolled(hashes: np.ndarray, width: int, power: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Hashes of each ``width`` words in a row, the same wherever they stand."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)], dtype=np.uint64)))
    return (sums[width:] - sums[:-width]) * back[: len(sums) - width]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least of each ``width`` values in a row."""
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at, have = np.where(x[right] < x[left], right, left), have + step
    return at


class Windows:
    """Pieces of the texts of a batch: starts of windows, and for each the gram under which it is filed."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram, n = window, gram, PIECE + window
        powers = [[np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64))), dtype=np.uint64) for b in (o, pow(o, -1, 1 << 64))] for o in ODD]
        self.first, self.second = powers

    def pieces(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Starts (within the piece), filed gram of each start, gram hashes, hashes of the piece's words, its offset."""
        n, w = len(words.flat), self.window
        room = np.repeat(words.bounds[1:], words.counts) - np.arange(n) >= w  # a window from here ends in the text
        for low in range(0, n, PIECE):
            hashes = words.hash[low : low + PIECE + w - 1]
            if len(hashes) < w:
                return
            starts = np.flatnonzero(room[low : low + PIECE])
            if len(starts):
                grams = mixed(rolled(hashes[:, 0], self.gram, *self.first))
                yield starts, least(grams, w - self.gram + 1)[starts], grams, hashes, low

    def keys(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rolled(hashes[:, 0], self.window, *self.first)[starts], rolled(hashes[:, 1], self.window, *self.second)[starts]


def cells_of(grams: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a gram in the two rows, of which the second follows the first."""
    low = np.uint64(cells - 1)
    return (grams & low).astype(np.uint32), ((mixed(grams ^ np.uint64(ODD[1])) & low) + np.uint64(cells)).astype(np.uint32)


def _count(cells: int, window: int, gram: int) -> Callable:
    """Sketch of a partition, in slices: cells counted once, and those counted more often."""
    names, width = ["slice", "once", "more"], min(SLICE, cells)

    def given(got: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every, n = np.unique(np.concatenate(got), return_counts=True)
        cuts = np.flatnonzero(np.concatenate(([True], every[1:] // width != every[:-1] // width)))
        for a, b in zip(cuts, [*cuts[1:], len(every)], strict=True):
            inside = every[a:b] % np.uint32(width)
            parts = [inside[n[a:b] == 1], inside[n[a:b] > 1]]
            # byte planes of the steps: the upper ones are nearly all zero
            coded = [np.diff(p, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([int(every[a]) // width], pa.int32()), *[pa.array([c], pa.binary()) for c in coded]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, got, size = Windows(window, gram), [], 0
        for batch in batches:
            for part in split_batch(batch, 4 << 20):
                for _, filed, grams, _, _ in by.pieces(Words(part.column(0))):
                    got += cells_of(grams[np.unique(filed)], cells)
                    size += 2 * len(got[-1])
                if size > FULL:
                    yield from given(got)
                    got, size = [], 0
        if got:
            yield from given(got)

    return run


def _merge(cells: int) -> Callable:
    """Slices come together; one bit a cell is left of them."""
    width = min(SLICE, cells)

    def steps(coded: bytes) -> np.ndarray:
        planes = np.frombuffer(coded, np.uint8).reshape(4, -1)
        return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, np.zeros(width, np.uint8)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(seen >= 2, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for slice_, once, more in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if now is not None and slice_ != now:
                    yield out()
                    seen[:] = 0
                now, at = slice_, steps(once)
                seen[at] = np.minimum(seen[at] + 1, 2)
                seen[steps(more)] = 2
        if now is not None:
            yield out()

    return run


def sketch(docs: DataFrame, cells: int = CELLS, window: int = WINDOW, gram: int = GRAM) -> bytes:
    """One bit a cell, 2 ``cells`` of them: whether grams in it are filed twice or more."""
    n, width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(SLICE, cells)
    parts = docs.select("text").mapInArrow(_count(cells, window, gram), "slice int, once binary, more binary")
    merged = parts.repartition(n, "slice").sortWithinPartitions("slice").mapInArrow(_merge(cells), "slice int, bits binary")
    bits = bytearray(2 * cells // 8)
    for row in merged.collect():  # 2 * cells bits at most
        bits[row["slice"] * width // 8 : (row["slice"] + 1) * width // 8] = row["bits"]
    return bytes(bits)


def _may_repeat(grams: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    return np.logical_and(*((bits[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1 for c in cells_of(grams, cells)))


def _candidates(shared, cells: int, window: int, gram: int) -> Callable:
    """Windows that may be repeated: 128 bits of hash (a, b), and the text (key, and the upper half of at) and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, bits = Windows(window, gram), np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for part in split_batch(batch, 4 << 20):
                words = Words(part.column(0))
                key, more = part.column(1).to_numpy(), part.column(2).to_numpy().astype(np.uint64) << np.uint64(32)
                for starts, filed, grams, hashes, low in by.pieces(words):
                    starts = starts[_may_repeat(grams[filed], bits, cells)]
                    text = np.searchsorted(words.bounds, starts + low, "right") - 1
                    at = more[text] | (starts + low - words.bounds[text]).astype(np.uint64)
                    a, b = by.keys(hashes, starts)
                    arrays = [x.view(np.int64) for x in (a, b, key[text], at)]
                    for s in range(0, len(starts), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(x[s : s + (1 << 16)]) for x in arrays], names=["a", "b", "key", "at"])

    return run


def _cut(shared, cells: int, window: int, gram: int, schema: pa.Schema) -> Callable:
    """Texts without the words under repeated windows: candidates but for those that are ``alone``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, bits = Windows(window, gram), np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for part in split_batch(batch, 4 << 20):
                words, alone = Words(part.column("text")), part.column("alone")
                turns = np.zeros(len(words.flat) + window + 1, np.int32)
                repeated = np.zeros(len(words.flat), bool)
                for starts, filed, grams, _, low in by.pieces(words):
                    repeated[low + starts[_may_repeat(grams[filed], bits, cells)]] = True
                places = pc.list_value_length(alone).fill_null(0).to_numpy()
                repeated[np.repeat(words.bounds[:-1], places) + alone.flatten().to_numpy()] = False
                starts = np.flatnonzero(repeated)
                np.add.at(turns, starts, 1)
                np.subtract.at(turns, starts + window, 1)
                stays = np.cumsum(turns)[: len(words.flat)] == 0
                left = np.concatenate(([0], np.cumsum(stays)))[words.bounds]
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.flat.filter(pa.array(stays))), " ")
                made = {"kept": kept, "n_words": pa.array(words.counts), "n_removed": pa.array(words.counts - np.diff(left))}
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else part.column(f.name) for f in schema], schema=schema)

    return run


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, cells: int = CELLS, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but text), kept (the words that stay, joined by one space), n_words and
    n_removed: one row per row.

    A word goes if a window of ``window`` words of its text that covers it starts at another place, in whatever text, too;
    overlapping windows and repeated rows count.  Texts are judged as they are given.  A null, empty or blank text has no
    words and is kept as an empty text; texts of fewer than ``window`` words stay whole; an empty table gives an empty
    result; columns of docs that have a result's name give way to it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    columns = [c for c in docs.columns if c != "text"] if keep is None else keep
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("key"), F.crc32(text.cast("binary")).alias("more"))
    with scratch(spark):
        shared = spark.sparkContext.broadcast(sketch(texts, cells, window, gram))
        found = texts.mapInArrow(_candidates(shared, cells, window, gram), "a long, b long, key long, at long")
        # min() is of the one row where there is but one
        once = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("at").alias("at")).filter("n = 1")
        low = F.lit((1 << 32) - 1)
        once = once.select("key", F.shiftrightunsigned("at", 32).alias("more"), F.col("at").bitwiseAND(low).alias("place"))
        alone = staged(once.groupBy("key", "more").agg(F.collect_list("place").alias("alone")), "alone", kept=True)
    whole = docs.select(packed(columns).alias("rec"), text.alias("text"), F.xxhash64(text).alias("key"), F.crc32(text.cast("binary")).alias("more"))
    whole = whole.join(alone, ["key", "more"], "left").select("rec", "text", F.coalesce("alone", F.array().cast("array<bigint>")).alias("alone"))
    out = StructType([whole.schema["rec"], StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    done = whole.mapInArrow(_cut(shared, cells, window, gram, to_arrow_schema(out)), out)
    return done.select(*unpacked("rec", columns, ("kept", "n_words", "n_removed")), "kept", "n_words", "n_removed")
