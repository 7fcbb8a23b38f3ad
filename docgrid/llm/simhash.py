"""SimHash near-duplicate detection with pigeonring filtering.

The 64 bits lie in sixteen segments on a ring.  If two fingerprints differ in at most two bits, there is a segment from
which every chain of consecutive segments stays within its proportional budget: the first ``l`` segments differ in at
most ``floor(l * 2 / 16)`` bits in sum.  So the first seven segments of that chain are equal: these 28 bits are the join
key, and longer chains and the whole Hamming distance are checked for what the key brings together.

Only distinct fingerprints are compared.  A key with more than ``BUCKET`` of them isn't compared pair by pair: its
fingerprints are linked, exactly, through the 65 values at a distance of at most one from each, since two fingerprints
within two bits share such a value and all that share one are within two bits of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, observed, packed, scratch, staged, unpacked

SEED = 42
WORDS = 3
DISTANCE = 2
SEGMENTS = 16
WIDTH = 64 // SEGMENTS
CHAIN = 7
BUCKET = 2048
BLOCK = 1 << 17


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a whole text's word shingles, repeats included; 0 without words."""
    words = b" ".join((text or "").encode().lower().split())  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    border = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    start, end = np.concatenate(([0], border + 1)), np.concatenate((border, [len(words)]))
    if len(start) > WORDS:
        start, end = start[: 1 - WORDS], end[WORDS - 1 :]
    else:
        start, end = start[:1], end[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for s in range(0, len(start), BLOCK):
        h = np.array([digest(words[a:b], SEED) for a, b in zip(start[s : s + BLOCK].tolist(), end[s : s + BLOCK].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed) of every row."""

    def make():
        return lambda c: {"doc_id": c["doc_id"], "fp": [fingerprint(t) for t in c["text"]]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, fp long", raw=("doc_id",))


def within(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the pairs that pass every chain from segment ``first`` on and then the full Hamming check."""
    x = a ^ b
    place = np.arange(len(x))
    spent = np.zeros(len(x), np.uint8)
    for length in range(1, SEGMENTS + 1):
        at = ((first + length - 1) % SEGMENTS * WIDTH).astype(np.uint64)
        spent = spent + np.bitwise_count((x >> at) & np.uint64((1 << WIDTH) - 1))
        ok = spent <= length * DISTANCE // SEGMENTS
        x, first, spent, place = x[ok], first[ok], spent[ok], place[ok]
    return place[np.bitwise_count(x) <= DISTANCE]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest of its component) of the graph of the pairs: as many as members, never as pairs."""
    nodes, idx = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = idx[: len(a)], idx[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within buckets; the rows (key, first, fp) come sorted by key, and a bucket may span batches."""
    held = None
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(key: np.ndarray, first: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        place = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        left = np.repeat(place[1:], np.diff(place)) - np.arange(len(key)) - 1  # rows of the bucket after this one
        rows, gap, got, size = np.flatnonzero(left >= 1), 1, [], 0
        while len(rows):
            ok = rows[within(fp[rows], fp[rows + gap], first[rows])]
            got.append((fp[ok], fp[ok + gap]))
            size += len(ok)
            gap += 1
            rows = rows[left[rows] >= gap]
            if size > 1 << 20 or (not len(rows) and size):
                a, b = spanning(*(np.concatenate(x) for x in zip(*got, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=out)
                got, size = [], 0

    for batch in batches:
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        if held:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        held = [x[cut:] for x in now]
        if cut:
            yield from edges(*(x[:cut] for x in now))
    if held:
        yield from edges(*held)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints ``fp`` that give the same components as all links within two bits."""
    ring = []
    for i in range(SEGMENTS):
        turned = F.when(F.lit(i > 0), F.shiftrightunsigned("fp", i * WIDTH).bitwiseOR(F.shiftleft("fp", 64 - i * WIDTH))).otherwise(F.col("fp")) if i else F.col("fp")
        ring.append(F.struct(F.shiftleft(turned.bitwiseAND((1 << CHAIN * WIDTH) - 1), 4).bitwiseOR(F.lit(i)).alias("key"), F.lit(i).cast("long").alias("first")))
    keyed = distinct.select(F.explode(F.array(*ring)).alias("r"), "fp").select("r.key", "r.first", "fp")
    # alone in a bucket means no partner there
    keyed = keyed.join(staged(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys"), "key")
    small = keyed.filter(F.col("n") <= BUCKET).select("key", "first", "fp").repartition("key").sortWithinPartitions("key")
    near = small.mapInArrow(_bucket_edges, "a long, b long")
    crowd = keyed.filter(F.col("n") > BUCKET).select("fp").distinct()
    around = crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(64)])).alias("mid"))
    close = around.groupBy("mid").agg(F.collect_set("fp").alias("all"))  # 65 members at most
    close = close.filter(F.size("all") > 1).select(F.explode("all").alias("a"), F.array_min("all").alias("b")).filter("a != b")
    return staged(near.unionByName(close).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """fp and root (the component's smallest fp) of every fingerprint that has a link, by alternating stars.

    Each round is written to shared storage; rounds grow as the logarithm of a component's diameter.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    seen = None
    while True:
        # large star: larger neighbours go to the smallest of a node and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        now, mark = observed(small, "stars", n=F.count(F.lit(1)), s=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if mark == seen:
            return now.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
        seen = mark


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id that links reach, the document's own included; ids that are null don't count,
    and a component of such only has a null one.  Null, empty and blank texts have fingerprint zero and link as others;
    repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    rows = staged(fingerprints(docs), "fingerprints", kept=True)
    with scratch(docs.sparkSession):
        least = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
        roots = staged(components(links(least.select("fp"))), "roots")
        joined = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        of_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
        to = staged(joined.join(of_root, "root").select("fp", "component_id"), "components", kept=True)
    out = rows.join(to, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component; no column is touched, whatever its name.

    Components are those of ``jaccard``: five-word shingle sets with a similarity of at least 0.8, whatever the texts'
    length; null, empty and blank texts are one component.  The row with the smallest doc_id stays, one without an id
    only where no other is there; of rows that repeat this doc_id the one with the least hash of all columns but maps.
    An empty table gives an empty result.
    """
    from . import jaccard

    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    # a null leaves the hash as it is, so whether a value is null is hashed too
    parts = [part for c in hashed for part in (c.isNull(), c)]
    # 128 bits, so that rows told apart by it are not taken for one row at any size
    hash_ = F.struct(F.xxhash64(*parts).alias("one"), F.xxhash64(F.lit(1), *parts).alias("two"))
    rows = docs.select("doc_id", jaccard.text_key(F.col("text")).alias("text_key"), hash_.alias("hash"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    # which rows stay is found on ids and hashes; the rows themselves move once, dealt by a hash that copies don't share
    with scratch(docs.sparkSession):
        first = rows.join(jaccard.text_roots(docs), "text_key").groupBy("root").agg(F.min(order)["hash"].alias("hash"))
        stay = staged(first.select("hash").distinct(), "stay", kept=True)
    whole = docs.select(packed(docs.columns).alias("rec"), hash_.alias("hash")).join(stay, "hash")
    place = F.row_number().over(Window.partitionBy("hash").orderBy(F.xxhash64("rec.text")))
    return whole.withColumn("place", place).filter("place = 1").select(*unpacked("rec", docs.columns))
