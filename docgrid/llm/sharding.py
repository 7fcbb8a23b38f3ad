"""Sharding by a k-d tree over document metadata.

A node's documents are split along the dimension in which they spread widest, at the weighted median that gives either
side its part of the bytes, until each leaf has the target bytes: one shard.  The median is found by Spark in three
aggregations of bounded size a level: 4096 steps of every dimension, then 4096 and 4096 slices of a hash for ties.  The
hash includes a number that tells repeated rows apart, so that a median can run through a group of equal rows.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, occurrences, staged, unpacked

SHARDS = 24
STEPS = 4096
DIMENSIONS = ("length", "lang", "source")


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def metadata() -> dict[str, Column]:
    """size, crc, id (equal for equal rows) and the dimensions as steps 0 to 4095: length on a logarithmic scale, lang
    and source by hash."""
    size, crc = size_of(F.col("text")), crc_of(F.col("text"))
    named = lambda c: F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(c), F.lit(""))), 52).cast("int")
    return {
        "size": size,
        "crc": crc,
        "id": F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), crc, size),
        "length": F.least(F.floor(F.log2(size.cast("double")) * (STEPS / 48)), F.lit(STEPS - 1)).cast("int"),
        "lang": named("lang"),
        "source": named("source"),
    }


@dataclass
class Node:
    """A leaf has ``shard``; an inner node sends rows with (dimension, tie) below (``step``, ``tie``) to the left."""

    shards: int
    shard: int = -1
    dimension: str = ""
    step: int = 0
    tie: int = 0
    left: Node | None = None
    right: Node | None = None

    def column(self, leaf) -> Column:
        """An expression that walks the tree; ``leaf`` gives a leaf's value."""
        if not self.dimension:
            return F.lit(leaf(self))
        d, h = F.col(self.dimension), F.col("tie")
        return F.when((d < self.step) | ((d == self.step) & (h < self.tie)), self.left.column(leaf)).otherwise(self.right.column(leaf))

    def leaves(self) -> list[Node]:
        return self.left.leaves() + self.right.leaves() if self.dimension else [self]


def _crossing(weights: dict[int, int], before: int, goal: float) -> tuple[int, int]:
    """The value at which the running weight reaches ``goal``, and the weight before it."""
    for value, weight in sorted(weights.items()):
        if before + weight >= goal:
            return value, before
        before += weight
    return value, before - weight


def _counted(rows: DataFrame, *by: Column) -> dict:
    """Bytes by node and value, as dictionaries."""
    out: dict = defaultdict(dict)
    for r in rows.groupBy("node", *by).agg(F.sum("size").alias("w")).collect():
        out[r[:-2] if len(r) > 3 else r[0]][r[-2]] = r[-1]
    return out


def build(meta: DataFrame, shards: int = SHARDS) -> Node:
    """The tree for rows of (size, tie, dimensions); what reaches the driver has at most 3 x ``shards`` x 4096 rows at a
    time."""
    root = Node(shards)
    spread: dict[str, int] = {}
    while open_nodes := [n for n in root.leaves() if n.shards > 1]:
        number = {id(n): k for k, n in enumerate(open_nodes)}
        at = meta.withColumn("node", root.column(lambda n: number.get(id(n), -1)).cast("int")).filter("node >= 0")
        dims = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.col(d).alias("v")) for i, d in enumerate(DIMENSIONS)])).alias("e")
        steps = _counted(at.select("node", "size", dims), F.col("e.d").alias("d"), F.col("e.v").alias("v"))
        goals, found, digits = {}, {}, {}
        for k, n in enumerate(open_nodes):
            wide = {d: max(steps[k, i]) - min(steps[k, i]) for i, d in enumerate(DIMENSIONS) if (k, i) in steps}
            spread = spread or {d: max(1, w) for d, w in wide.items()}
            n.dimension = max(DIMENSIONS, key=lambda d: wide.get(d, 0) / spread.get(d, 1))
            if wide:
                weights = steps[k, DIMENSIONS.index(n.dimension)]
                goals[k] = sum(weights.values()) * (n.shards // 2) / n.shards
                value, before = _crossing(weights, 0, goals[k])
                digits[k], found[k] = [value], (weights[value], before)
        # the hash's digits within the step, then within the first digit
        high, low = F.shiftright("tie", 12), F.col("tie").bitwiseAND(4095)
        for depth, part in enumerate((high, low)):
            here = F.lit(False)
            for k, n in enumerate(open_nodes):
                if k in goals:
                    same = (F.col("node") == k) & (F.col(n.dimension) == digits[k][0])
                    here = here | (same & (high == digits[k][1]) if depth else same)
            by = _counted(at.filter(here), part.cast("int").alias("v")) if goals else {}
            for k in goals:
                value, before = _crossing(by[k], found[k][1], goals[k])
                digits[k].append(value)
                found[k] = (by[k][value], before)
        for k, n in enumerate(open_nodes):
            if k in goals:
                weight, before = found[k]
                # the slice on the border goes to the side that it leaves nearer to its part
                n.step, n.tie = digits[k][0], (digits[k][1] << 12) + digits[k][2] + (before + weight - goals[k] <= goals[k] - before)
            n.left, n.right = Node(n.shards // 2), Node(n.shards - n.shards // 2)
    for k, leaf in enumerate(root.leaves()):
        leaf.shard = k
    return root


def tie(identity: str = "id", occ: str = "occ") -> Column:
    """24 bits by which rows of one step are told apart."""
    return F.shiftrightunsigned(F.xxhash64(identity, occ), 40).cast("int")


NEW = ("size", "text_crc32", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``, by default all) with shard (0 to shards - 1) and slot (gapless from 0 in each
    shard), size and text_crc32.

    The bytes of the shards are near equal, repeated rows and groups of equal texts included: a border differs from its
    exact place by less than a document.  Reads doc_id, text, lang and source; nulls are empty, ids may be of any type.
    Repeated rows are interchangeable, so which of them gets which slot is open.  An empty table gives an empty result.
    Columns of ``docs`` named like the new ones, in whatever case, are replaced.
    """
    columns = keep or docs.columns
    base = numbered(docs, "sharding", columns, **metadata())
    meta = occurrences(base.drop("rec"), "id", "occurrences").withColumn("tie", tie())
    tree = build(meta, shards)
    placed = meta.withColumn("shard", tree.column(lambda n: n.shard).cast("int")).withColumn("slice", F.shiftright("tie", 12))
    # at most shards x 4096 rows
    counts = staged(placed.groupBy("shard", "slice").agg(F.count("*").alias("n")), "slots")
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "slice").orderBy("tie", "id", "occ", "rid")
    ranked = placed.withColumn("rank", F.row_number().over(order)).join(starts, ["shard", "slice"])
    slots = ranked.select("rid", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))
    out = base.join(slots, "rid")
    return out.select(*unpacked("rec", columns, NEW), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
