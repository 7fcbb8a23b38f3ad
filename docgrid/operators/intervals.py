"""Trees as intervals: pre- and post-order numbers instead of stored pairs.

A walk around the forest enters and leaves every node once.  Each of these events knows the next one, and pointer doubling
gives all of them their place in the walk in as many rounds as the logarithm of its length.  What is below a node then is
what is entered between its two places, so a forest is stored as one row a node, whatever its depth.

A cycle is cut at its smallest node; its nodes keep the interval of the whole, since each of them is above all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.operators.staging import cut

FEW = 2_000  # hits that are sent to all labels; more are met by blocks


def _doubled(rows: DataFrame) -> DataFrame:
    """One round: every jump is twice as long, and the least node on its way is known; a null jump has left the forest."""
    other = rows.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"))
    return cut(rows.join(other, "jump", "left").select("id", F.col("jump2").alias("jump"), F.least("low", "low2").alias("low")))


def _cycles(links: DataFrame) -> DataFrame:
    """(id, first, length) of the nodes on cycles: the cycle's smallest node and how many there are."""
    now, before = cut(links.select("id", F.col("parent").alias("jump"), F.col("id").alias("low"))), -1
    while (active := now.filter("jump IS NOT NULL").count()) not in (0, before):
        # depths have no gaps, so a round that ends no way leaves only ways that never end
        now, before = _doubled(now), active
    now, seen = now.filter("jump IS NOT NULL") if active else now.limit(0), None
    while active:
        # images shrink until they are the cycles
        image = now.select(F.col("jump").alias("id")).distinct()
        mark = now.join(image, "id", "left_semi").agg(F.count("*"), F.sum(F.xxhash64("id", "low").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, now = mark, _doubled(now)
    found = now.join(now.select(F.col("jump").alias("id")).distinct(), "id", "left_semi").select("id", F.col("low").alias("first"))
    return cut(found.join(found.groupBy("first").agg(F.count("*").alias("length")), "first"))


def _next_siblings(nodes: DataFrame) -> DataFrame:
    """(id, sibling): the next node of the same parent, found in ranges, so that a parent's children can be many tasks."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("parent").asc_nulls_first(), "o", "id"]
    rows = nodes.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id())
    rows = cut(rows.select("id", "parent", "pid", "k"))
    w = Window.partitionBy("pid").orderBy("k")
    one = rows.select("id", "parent", "pid", F.lead(F.struct("id", "parent")).over(w).alias("after"), F.lead("k").over(w).isNull().alias("last"))
    # a row a partition
    heads = rows.groupBy("pid").agg(F.min_by(F.struct("id", "parent"), "k").alias("head"))
    heads = heads.select((F.lag("pid").over(Window.orderBy("pid"))).alias("pid"), F.col("head"))
    one = one.join(F.broadcast(heads), "pid", "left")
    after = F.when(F.col("last"), F.col("head")).otherwise(F.col("after"))
    return one.select("id", F.when(after["parent"].eqNullSafe(F.col("parent")) & after["id"].isNotNull(), after["id"]).alias("sibling"))


def labels(nodes: DataFrame, key: str = "id", parent: str = "parent_id", order: str | None = None) -> DataFrame:
    """id, pre, post, depth, low, high and cycle (its length, for nodes on one) of every node, as text ids.

    ``nodes`` has a row a node; a parent that is no node is taken for a root.  What is entered between ``low`` and ``high``
    is below a node: its own interval, or the cycle's.  Siblings are in the order of ``order``, then id.
    """
    rows = nodes.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(parent).cast("string").alias("parent"), (F.col(order) if order else F.lit(0)).alias("o"))
    missing = rows.select(F.col("parent").alias("id")).filter("id IS NOT NULL").distinct().join(rows.select("id"), "id", "left_anti")
    rows = cut(rows.unionByName(missing.select("id", F.lit(None).cast("string").alias("parent"), F.lit(None).cast(rows.schema["o"].dataType).alias("o"))))
    on = _cycles(rows)
    rows = cut(rows.join(on, "id", "left").withColumn("parent", F.when(F.col("id") == F.col("first"), F.lit(None)).otherwise(F.col("parent"))))
    child = rows.filter("parent IS NOT NULL").groupBy("parent").agg(F.min(F.struct(F.col("o").isNotNull(), "o", "id"))["id"].alias("child")).withColumnRenamed("parent", "id")
    walk = rows.select("id", "parent").join(child, "id", "left").join(_next_siblings(rows), "id", "left")
    into, out_of = (lambda c: F.concat(F.lit("+"), c)), (lambda c: F.concat(F.lit("-"), c))
    enter = walk.select(into(F.col("id")).alias("event"), F.coalesce(into(F.col("child")), out_of(F.col("id"))).alias("next"), F.lit(1).cast("long").alias("w"))
    leave = walk.select(out_of(F.col("id")).alias("event"), F.coalesce(into(F.col("sibling")), out_of(F.col("parent"))).alias("next"), F.lit(-1).cast("long").alias("w"))
    events = cut(enter.unionByName(leave).withColumn("left", F.lit(1).cast("long")))
    total = events.count()
    while not events.filter("next IS NOT NULL").isEmpty():
        other = events.select(F.col("event").alias("next"), F.col("next").alias("next2"), F.col("w").alias("w2"), F.col("left").alias("left2"))
        zero = F.lit(0).cast("long")
        events = cut(events.join(other, "next", "left").select("event", F.col("next2").alias("next"), (F.col("w") + F.coalesce("w2", zero)).alias("w"), (F.col("left") + F.coalesce("left2", zero)).alias("left")))
    at = events.select(F.substr("event", F.lit(2)).alias("id"), F.startswith("event", F.lit("+")).alias("enters"), (F.lit(total) - F.col("left")).alias("place"), (-F.col("w")).alias("depth"))
    at = at.groupBy("id").agg(F.max(F.when(F.col("enters"), F.col("place"))).alias("pre"), F.max(F.when(~F.col("enters"), F.col("place"))).alias("post"), F.max(F.when(F.col("enters"), F.col("depth"))).alias("depth"))
    at = cut(at.join(on, "id", "left"))
    whole = at.filter(F.col("id") == F.col("first")).select("first", F.col("pre").alias("low"), F.col("post").alias("high"))
    return at.join(whole, "first", "left").select("id", "pre", "post", "depth", F.coalesce("low", "pre").alias("low"), F.coalesce("high", "post").alias("high"), F.col("length").alias("cycle"))


def _blocks(low: Column, high: Column, levels: int) -> Column:
    """Aligned blocks of doubling sizes that together are [low, high]: at most two of a size."""

    def of(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        a, b = F.ceil(low / size).cast("long"), F.floor((high + 1) / size).cast("long")
        block = lambda x, odd: F.when((a < b) & (odd % 2 == 1), F.struct(k.alias("k"), x.alias("at")))
        return F.array(block(a, a), block(b - 1, b))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of)))


def pairs(below: DataFrame, above: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of labels ``below`` and ``above``.

    A few of either side go to all of the other; else the intervals are taken apart into aligned blocks, and a node meets
    those that have its place by equality.
    """
    a, d = (rows.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "pre", "post", "depth", "low", "high", "cycle")]) for rows, side in ((above, "a"), (below, "d")))
    inside = F.col("d_pre").between(F.col("a_low"), F.col("a_high")) & (F.col("d_id") != F.col("a_id"))
    if a.limit(FEW + 1).count() <= FEW:
        met = d.join(F.broadcast(a), inside)
    elif d.limit(FEW + 1).count() <= FEW:
        met = a.join(F.broadcast(d), inside)
    else:
        levels = max(1, int(a.agg(F.coalesce(F.max("a_high"), F.lit(1))).first()[0])).bit_length()
        place = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("k"), F.floor(F.col("d_pre") / F.pow(F.lit(2.0), k)).cast("long").alias("at")))
        met = a.withColumn("block", F.explode(_blocks(F.col("a_low"), F.col("a_high"), levels))).join(d.withColumn("block", F.explode(place)), "block").filter("d_id <> a_id")
    straight = F.col("d_pre").between(F.col("a_pre"), F.col("a_post"))
    distance = F.col("d_depth") - F.col("a_depth") + F.when(straight, 0).otherwise(F.col("a_cycle"))
    return met.select(F.col("a_id").alias("ancestor"), F.col("d_id").alias("descendant"), distance.cast("int").alias("distance"))


def around(labelled: DataFrame, hits: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of the hits (column id) with all above and below them."""
    some = cut(labelled.join(hits.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi"))
    return pairs(some, labelled).unionByName(pairs(labelled, some)).distinct()
