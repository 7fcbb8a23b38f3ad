"""Mixing sources to target weights by systematic sampling.

Targets come from weights by water filling.  Within a source every document is expected ``target / source size`` times;
these expectations are prefix-summed, a random offset of the source is added, and a document is emitted once for each
whole number that its interval crosses.  Documents go by falling size, so that the words taken differ from the target
by less than the source's largest document.

The offset is the source's random number, or where this takes words over ``NEAR`` off the target (in a source of not so
many documents) the first of its ``TURNS`` even turns that does not, else the nearest; the counts of sizes tell this
without a look at the documents.  So in large sources documents are taken as often as their rate says.

Rates and offsets are whole numbers of 2^-24, so the crossings are exact for up to 2^37 documents of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, occurrences, staged, unpacked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
TURNS = 32
NEAR = 0.001
BITS = 24
ONE = 1 << BITS


def word_count(text: Column) -> Column:
    """Number of words of a whole text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def identity(doc_id: Column, text: Column) -> Column:
    """A text that is equal for rows of equal id and text, and orders the documents of a size as by chance."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from rows of (source, source_size), one for each source.

    Sources by code point, null last, have the weights in turn.  The windows run over sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("weight", F.get(turn, (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    order = [F.col("ratio"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    # the first source, by ratio, that the level doesn't fill: it and all later ones get the level times their weight
    at = F.row_number().over(Window.orderBy(*order))
    s = s.withColumn("at", at).withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.col("at")))
    s = s.withColumn("level", F.min_by("level", "fits").over(every))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The source's random number, 0 to 2^24 - 1, the same at every run."""
    named = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("|"), source), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 6), 16, 10).cast("long")


def crossed(start: Column, end: Column, rate: Column, turned: Column) -> Column:
    """Whole numbers that the expectations of documents ``start`` + 1 to ``end`` cross."""
    return F.shiftright(end * rate + turned, BITS) - F.shiftright(start * rate + turned, BITS)


def nearest_offsets(sizes: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """skey, source_size, target, rate, turned: the first turn of the source's random number that takes near its target.

    ``sizes`` has a row for each size of a source, with how many documents have it (n) and how many are larger (start).
    """
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * ONE)).otherwise(F.lit(0)).cast("long")
    t = targets.select(key("source").alias("skey"), "source_size", "target", rate.alias("rate"), offset(F.col("source"), seed).alias("u"))
    turn = lambda k: (F.col("u") + k * (ONE // TURNS)) % ONE
    taken = [F.sum(F.col("size") * crossed(F.col("start"), F.col("start") + F.col("n"), F.col("rate"), turn(k))).alias(f"t{k}") for k in range(TURNS)]
    sums = sizes.join(t, "skey").groupBy("skey", "source_size", "target", "rate", "u").agg(*taken)
    miss = lambda k: F.abs(F.col(f"t{k}") - F.col("target"))
    far = lambda k: miss(k) > F.col("target") * NEAR
    best = F.array_min(F.array(*[F.struct(far(k).alias("far"), F.when(far(k), miss(k)).otherwise(0.0).alias("miss"), F.lit(k).alias("k"), turn(k).alias("u")) for k in range(TURNS)]))
    return sums.select("skey", "source_size", "target", "rate", best["u"].alias("turned"))


def key(source: str) -> Column:
    """A source as a key that is never null and differs for all sources."""
    return F.coalesce(F.concat(F.lit("|"), F.col(source)), F.lit(""))


def planned(docs: DataFrame, seed: str, weights: tuple[int, ...], share: float, most: int, keep: list[str]) -> DataFrame:
    """rec (the columns ``keep`` packed), size, source_size, target, copies of every row.

    Texts are read once, when the rows are staged; ranks are found on sizes, sources and hashes alone.
    """
    base = numbered(docs, "mixing", keep, size=word_count(F.col("text")), source=F.col("source"), id=identity(F.col("doc_id"), F.col("text")))
    meta = occurrences(base.select("rid", "size", key("source").alias("skey"), "id"), "id", "occurrences")
    # cells: the documents of a size of a source, in 256 slices by hash, as many slices as are filled
    meta = meta.withColumn("slice", F.substring("id", 1, 2))
    counts = staged(meta.groupBy("skey", "size", "slice").agg(F.count("*").alias("n")), "sizes")
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    bigger = Window.partitionBy("skey").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("skey", "size").agg(F.sum("n").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(bigger), F.lit(0)))
    offsets = staged(nearest_offsets(sizes, source_targets(sources, weights, share, most), seed), "offsets")
    left = Window.partitionBy("skey", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("within", F.coalesce(F.sum("n").over(left), F.lit(0))).drop("n")
    starts = within.join(sizes.select("skey", "size", "start"), ["skey", "size"]).select("skey", "size", "slice", (F.col("start") + F.col("within")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("skey", "size", "slice").orderBy("id", "occ"))
    place = F.col("start") + F.col("rank")
    copies = crossed(place - 1, place, F.col("rate"), F.col("turned"))
    found = meta.withColumn("rank", rank).join(starts, ["skey", "size", "slice"]).join(offsets, "skey")
    return base.select("rid", "rec", "size").join(found.select("rid", "source_size", "target", copies.alias("copies")), "rid")


NEW = ("size", "source_size", "target", "copies")


def with_copies(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``, by default all) with size, source_size, target and copies (how often the mix takes
    the document), all rows kept.

    Reads doc_id (of any type), text and source.  Null sources are one source, the last; null and empty texts have size
    0 and take part as others do; ties of size go by a hash of id and text, and rows equal in both are interchangeable;
    in an empty table nothing is taken.  Columns of ``docs`` named like the new ones, in whatever case, are replaced.
    """
    columns = keep or docs.columns
    return planned(docs, seed, weights, share, most, columns).select(*unpacked("rec", columns, NEW), *NEW)


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken, with the columns of ``docs`` as they were.

    Nulls, ties, repeated rows and empty tables as in ``with_copies``.
    """
    taken = planned(docs, seed, weights, share, most, docs.columns).filter("copies > 0")
    return taken.select("rec", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*unpacked("rec", docs.columns))
