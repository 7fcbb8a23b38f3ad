"""Near duplicates by the Jaccard similarity of five-word shingle sets, pruned by wide SimHashes.

Two sets of similarity 0.8 differ in 15 % of the bits of their SimHashes, so no key of equal segments is both selective
and shared by nearly all such pairs (24 equal bits: 2 % of them).  Candidates are therefore sets that share one of
``BANDS`` bands of ``ROWS`` minimum hashes; a pair of similarity 0.8 shares none with a probability of 3e-6, a nearer
pair with less.  Candidates pass the pigeonring filter on a SimHash of 256 bits, whose chains of consecutive words must
stay within the proportional part of ``BUDGET``, and the full Hamming check; what is left is proved by the exact
similarity of the two sets.  A pair within the budget always has such a chain, so the filter never decides otherwise
than the full check; with four words it isn't cheaper either, so joins of pairs ask for the full distance at once and
only tiles look at chains first.  Texts of equal sets are one node.

A bucket isn't compared pair by pair at once.  First all its sets are compared with ``STARS`` of them.  After that only
buckets whose sets aren't in one component yet go on: small ones pair by pair, large ones in tiles of two blocks of
their sets.  A tile first gets the SimHashes of its blocks, a row each; only the sets that have somebody within the
budget there are sent to it, compared by matrix products, and only edges that connect something leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limited, map_rows, staged
from .simhash import components, spanning

SEED = 42
WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
WIDE = 4
BUDGET = 72
STARS = 2
FEW = 16
BLOCK_SETS = 512
BLOCK_SHINGLES = 400_000
BLOCK = 1 << 9
COLUMNS = 4096

_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_SPREAD = _random.integers(0, 1 << 63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; one of all words if they are fewer than five, none without words."""
    words = b" ".join((text or "").encode().lower().split())  # bytes.lower and bytes.split know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    border = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    start, end = np.concatenate(([0], border + 1)), np.concatenate((border, [len(words)]))
    if len(start) > WORDS:
        start, end = start[: 1 - WORDS], end[WORDS - 1 :]
    else:
        start, end = start[:1], end[-1:]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(words[a:b], SEED) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """Signed keys of a set's bands; none for a set so small that only an equal one is similar enough."""
    if len(hashes) < SIMILARITY * (len(hashes) + 1):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(hashes), BLOCK):
        part = hashes[None, s : s + BLOCK] ^ _MIX[:, None]
        part *= _TIMES[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def wide(hashes: np.ndarray) -> list[int]:
    """The SimHash of a set: ``WIDE`` signed words, in which a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64 * WIDE, np.int64)
    for s in range(0, len(hashes), BLOCK):
        x = hashes[s : s + BLOCK, None] * _SPREAD[None]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8").tolist()


def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows of words pass: some chain's every beginning within its budget, then the whole distance."""
    apart = np.bitwise_count(a ^ b).astype(np.int16)
    chains = np.ones(apart.shape, bool)
    spent = np.zeros(apart.shape, np.int16)
    for length in range(1, WIDE + 1):
        spent += np.roll(apart, 1 - length, axis=-1)
        chains &= spent <= length * BUDGET // WIDE
    return chains.any(axis=-1) & (apart.sum(axis=-1) <= BUDGET)


def distance(a: str, b: str) -> Column:
    """Hamming distance of two columns of words."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, WIDE)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def text_key(text: Column) -> Column:
    """128 bits of a text, so that texts told apart by it are not taken for copies at any size; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def shingled(docs: DataFrame) -> DataFrame:
    """text_key, sid (of the shingle set), n (its size), fp (its SimHash) and keys (of its bands) of every distinct text."""

    def make():
        def apply(c):
            sets = [shingles(t) for t in c["text"]]
            sid = [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
            return {"text_key": c["text_key"], "sid": sid, "n": [len(s) for s in sets], "fp": [wide(s) for s in sets], "keys": [bands(s) for s in sets]}

        return apply

    rows = map_rows(docs.select(text_key(F.col("text")).alias("text_key"), "text"), make, "text_key binary, sid long, n long, fp array<long>, keys array<long>", raw=("text_key",))
    return staged(rows.dropDuplicates(["text_key"]), "shingled")


def hashes_of(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Staged sid and hashes (the set's as bytes) for rows of sid and text_key."""
    wanted = limited(staged(asked.select("sid", "text_key"), "asked"))
    texts = docs.select(text_key(F.col("text")).alias("text_key"), "text").join(wanted, "text_key").groupBy("sid").agg(F.any_value("text").alias("text"))
    return staged(map_rows(texts, lambda: lambda c: {"sid": c["sid"], "hashes": [shingles(t).tobytes() for t in c["text"]]}, "sid long, hashes binary", raw=("sid",)), "hashes")


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, hashes_a, hashes_b) whose sets are similar, as (a, b)."""
    for batch in batches:
        sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(k)] for k in (2, 3)]
        ok = pa.array([similarity(x, y) >= SIMILARITY for x, y in zip(*sets, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])


def prove(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose exact similarity suffices."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets.select("sid", "text_key"), "sid")
    had = hashes_of(asked, docs)
    both = pairs.join(had.withColumnsRenamed({"sid": "a", "hashes": "hashes_a"}), "a").join(had.withColumnsRenamed({"sid": "b", "hashes": "hashes_b"}), "b")
    return staged(both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(_proved, "a long, b long"), "proved")


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of which set of ``left`` is similar to which of ``right``; exact, by products of blocks of columns."""
    n = np.array([len(s) for s in left + right], np.float32)
    row = np.repeat(np.arange(len(n)), n.astype(np.int64))
    _, column, often = np.unique(np.concatenate([*left, *right, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    twice = often > 1
    number = np.cumsum(twice) - 1
    row, column = row[twice[column]], number[column[twice[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(twice.sum()), COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        here = np.zeros((len(n), COLUMNS), np.float32)
        here[row[a:b], column[a:b] - start] = 1
        both += here[: len(left)] @ here[len(left) :].T
    # whole numbers below 2^24 are exact in these sums
    return both >= SIMILARITY * (n[: len(left), None] + n[None, len(left) :] - both) - 1e-6 * both


def _asked(table: pa.Table) -> pa.Table:
    """The sets (key, i, j, block, sid, root, fp) of a tile's one or two rows (key, i, j, block, sets) that may be similar
    to a set of the other block and aren't in one component with it."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    lists = table["sets"].combine_chunks()
    block, flat = np.repeat(table["block"].to_numpy(), lists.value_lengths().to_numpy()), lists.flatten()
    n, root = (flat.field(c).to_numpy() for c in ("n", "root"))
    fp = flat.field("fp").flatten().to_numpy().view(np.uint64).reshape(-1, WIDE)
    one, two, asked = np.flatnonzero(block == i), np.flatnonzero(block == j), np.zeros(len(block), bool)
    for s in range(0, len(one), 16):
        x, y = one[s : s + 16, None], two[None]
        some = (root[x] != root[y]) & (np.minimum(n[x], n[y]) >= SIMILARITY * np.maximum(n[x], n[y]) - 1e-6)
        some &= within(fp[x], fp[y])
        asked[one[s : s + 16][some.any(axis=1)]] = True
        asked[two[some.any(axis=0)]] = True
    at = np.flatnonzero(asked)
    flat, ones = flat.take(pa.array(at)), np.ones(len(at), np.int64)
    columns = {"key": pa.array(ones * table["key"][0].as_py()), "i": pa.array(ones * i), "j": pa.array(ones * j), "block": pa.array(block[at].astype(np.int64))}
    return pa.table(columns | {c: flat.field(c) for c in ("sid", "root", "fp")})


def _tile(table: pa.Table) -> pa.Table:
    """Edges (a, b) of a tile's rows (key, i, j, block, sid, root, fp, hashes) that connect its sets."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    block, sid, root = (table[c].to_numpy() for c in ("block", "sid", "root"))
    fp = np.array(table["fp"].to_pylist(), np.int64).view(np.uint64).reshape(len(sid), WIDE)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["hashes"]]
    one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
    asked = np.array([within(fp[x][None], fp[two]) & (root[x] != root[two]) for x in one]).reshape(len(one), len(two))
    one, two, asked = one[asked.any(axis=1)], two[asked.any(axis=0)], asked[asked.any(axis=1)][:, asked.any(axis=0)]
    if not asked.size:
        return out.empty_table()
    x, y = np.nonzero(asked & similar_pairs([sets[k] for k in one], [sets[k] for k in two]))
    # signed numbers as they are: only the partition into components matters
    a, b = spanning(sid[one[x]].view(np.uint64), sid[two[y]].view(np.uint64))
    return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=out)


def tiled(members: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the sets of each bucket as all its similar pairs do; members: key, sid, n, root, fp, size
    (sets of the bucket) and words (their shingles)."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("words") / BLOCK_SHINGLES)).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid", "key"), F.col("blocks")).cast("int"))
    # a block is a row of bounded length, which meets the other blocks as one
    rows = rows.groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("sid", "n", "root", "fp")).alias("sets"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sets")
    asked = rows.groupBy("key", "i", "j").applyInArrow(_asked, "key long, i long, j long, block long, sid long, root long, fp array<long>")
    asked = staged(asked, "asked_tiles")
    had = hashes_of(asked.select("sid").distinct().join(sets.select("sid", "text_key"), "sid"), docs)
    return staged(asked.join(had, "sid").groupBy("key", "i", "j").applyInArrow(_tile, "a long, b long"), "tiles")


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """fp and root of every set that has a link, where ``sets`` has distinct sid, n, fp, keys and a text_key of each."""
    keyed = sets.select("sid", F.explode("keys").alias("key"))
    crowd = staged(keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "crowd")
    # only what shares a key takes its SimHash along
    members = staged(keyed.join(crowd, "key").join(sets.select("sid", "n", "fp"), "sid"), "buckets").withColumn("root", F.col("sid"))
    near = (F.least("n", "n_b") >= SIMILARITY * F.greatest("n", "n_b") - 1e-6) & (F.col("root") != F.col("root_b")) & (distance("fp", "fp_b") <= BUDGET)
    asked = lambda a, b: a.join(b, "key").filter(near).select(F.least("sid", "sid_b").alias("a"), F.greatest("sid", "sid_b").alias("b")).distinct()
    stars = [F.min(F.struct(F.xxhash64("sid", F.lit(turn)), F.struct("sid", "n", "root", "fp")))["col2"] for turn in range(STARS)]
    centre = members.groupBy("key").agg(F.array_distinct(F.array(*stars)).alias("o")).select("key", F.explode("o").alias("o"))
    centre = centre.select("key", *[F.col(f"o.{c}").alias(f"{c}_b") for c in ("sid", "n", "root", "fp")])
    edges = prove(staged(asked(members, centre), "pairs"), docs, sets)
    roots = staged(components(edges), "roots")
    # buckets whose sets are all in one component have no more to find
    members = members.drop("root").join(roots.withColumnRenamed("fp", "of"), F.col("sid") == F.col("of"), "left").withColumn("root", F.coalesce("root", "sid")).drop("of")
    open_ = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size"), F.sum("n").alias("words"))
    open_ = open_.filter("x <> y").select("key", "size", "words")
    sized = staged(members.join(open_, "key"), "open")
    few, many = sized.filter(F.col("size") <= FEW), sized.filter(F.col("size") > FEW)
    other = few.select("key", *[F.col(c).alias(f"{c}_b") for c in ("sid", "n", "root", "fp")])
    edges = edges.unionByName(prove(staged(asked(few, other), "pairs"), docs, sets)).unionByName(tiled(many, docs, sets))
    return staged(components(edges), "roots")


def text_roots(docs: DataFrame) -> DataFrame:
    """Staged text_key and root, equal for near duplicates, of every distinct text."""
    rows = shingled(docs)
    sets = rows.groupBy("sid").agg(F.min(F.struct("text_key", "n", "fp", "keys")).alias("s")).select("sid", "s.*")
    roots = links(docs, staged(sets, "sets"))
    out = rows.select("text_key", "sid").join(roots.withColumnRenamed("fp", "sid"), "sid", "left")
    return staged(out.select("text_key", F.coalesce("root", "sid").alias("root")), "text_roots")
