"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Three fixed masks of weight five ignore some of the word positions they span.  Any ten words with two substitutions,
fifteen with three or twenty with four contain a hit of one of them, so joining the hashes of test and training
windows finds every alignment with a window of that similarity.  A hit is only a text's hash, an item and the
difference of their places; the hits are reduced to distinct alignments where they arise, and of these alone words are
compared, around their hits first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limited, packed, scratch, staged, unpacked

MASKS = ("11111", "111011", "11010011")
WINDOW = 20
LEAST_WORDS = 5
TOLERANT_FROM = 10
SIMILARITY = 0.8
BROADCAST_SEEDS = 400_000
BLOCKS = 8
PIECE = 1024
WHITE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-case words of a whole text; empty for null and blank texts."""
    trimmed = F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, WHITE), lambda w: F.xxhash64(w)))


def seeds(words: str, position: str) -> Column:
    """Hash of each mask's window that begins at ``position`` (from 0), of the words that the mask doesn't ignore; null
    where the window passes the end."""
    out = []
    for k, mask in enumerate(MASKS):
        picked = [F.get(F.col(words), F.col(position) + i) for i, flag in enumerate(mask) if flag == "1"]
        out.append(F.when(picked[-1].isNotNull(), F.xxhash64(F.lit(k), *picked)))
    return F.array(*out)


def windows(rows: DataFrame, key: str, words: str) -> DataFrame:
    """(key, seed, pos) of each window and mask of ``words``.

    Long texts are cut into pieces of ``PIECE`` words and those that their last windows need, so that no row that is
    made for a window has the whole text.
    """
    more = max(map(len, MASKS)) - 1
    cut = lambda s: F.struct(s.alias("start"), F.slice(words, s + 1, PIECE + more).alias("part"))
    parts = F.transform(F.sequence(F.lit(0), F.size(words) - LEAST_WORDS, F.lit(PIECE)), cut)
    pieces = rows.filter(F.size(words) >= LEAST_WORDS).select(key, F.explode(parts).alias("p")).select(key, "p.start", "p.part")
    at = pieces.select(key, "start", "part", F.explode(F.sequence(F.lit(0), F.least(F.size("part") - LEAST_WORDS, F.lit(PIECE - 1)))).alias("at"))
    return at.select(key, (F.col("start") + F.col("at")).alias("pos"), F.explode(seeds("part", "at")).alias("seed")).filter("seed is not null")


def hits(texts: DataFrame, planted: DataFrame) -> DataFrame:
    """Distinct alignments (tkey, ikey, diag) of texts (tkey, text) and planted seeds (seed, ikey, ipos), with the first
    and the last place in the item of their hits.

    The seeds go in blocks of ``BROADCAST_SEEDS`` at most, each broadcast to one scan of the texts.  Beyond ``BLOCKS``
    of them the windows are dealt by seed instead, as another scan would cost more than moving them once.
    """
    seen = windows(texts, "tkey", "dw").withColumnRenamed("pos", "dpos")
    blocks = max(1, -(-planted.count() // BROADCAST_SEEDS))
    if blocks > BLOCKS:
        found = seen.join(planted, "seed")
    else:
        found = reduce(DataFrame.unionByName, [seen.join(F.broadcast(planted.filter(F.pmod(F.xxhash64("seed", "ikey", "ipos"), F.lit(blocks)) == b)), "seed") for b in range(blocks)])
    aligned = found.select("tkey", "ikey", (F.col("dpos") - F.col("ipos")).alias("diag"), "ipos")
    return aligned.groupBy("tkey", "ikey", "diag").agg(F.min("ipos").alias("first"), F.max("ipos").alias("last"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """tkey (xxhash64 of a text), text, item_id, top (-matched, diag, item_words: the best alignment) of every distinct
    text and item that overlap."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("iw")).filter(F.size("iw") >= LEAST_WORDS).distinct()
    items = items.withColumn("ikey", F.xxhash64("item_id", "iw"))
    planted = windows(items, "ikey", "iw").withColumnRenamed("pos", "ipos")
    texts = docs.select(F.xxhash64("text").alias("tkey"), "text")
    found = staged(hits(texts.select("tkey", word_hashes(F.col("text")).alias("dw")), planted), "alignments")
    # the texts that have a hit, each once; a hash that two texts share does no harm, as each is compared itself
    some = texts.join(limited(found.select("tkey").distinct()), "tkey", "left_semi").distinct()
    some = some.select("tkey", "text", word_hashes(F.col("text")).alias("dw"))
    # an item and a text have as many alignments as words at most
    diags = found.groupBy("tkey", "ikey").agg(F.collect_list(F.struct("diag", "first", "last")).alias("diags"))
    return verified(some.join(diags, "tkey").join(items, "ikey"))


def verified(found: DataFrame) -> DataFrame:
    """tkey, text, item_id, top from rows of tkey, text, dw, item_id, iw and diags: the best of the alignments that pass.

    Alignments come by the most words that they could match.  One that can't beat the best so far isn't compared; of
    any other the words around its hits are, and the whole alignment only if a window there passes.  So repeated words,
    which pass in every alignment, cost about one alignment, and chance hits cost a window each.
    """
    size, width = F.size("iw"), F.least(F.size("iw"), F.lit(WINDOW))
    allowed = width - F.when(width < TOLERANT_FROM, width).otherwise(F.ceil(width * SIMILARITY)).cast("int")
    least_span = min(map(len, MASKS))

    def bounded(a: Column) -> Column:
        low, high = F.greatest(F.lit(0), -a["diag"]), F.least(size, F.size("dw") - a["diag"])
        begin, end = F.greatest(low, a["first"] + least_span - width), F.least(high, a["last"] + width)
        return F.struct((low - high).alias("m"), a["diag"].alias("d"), low.alias("low"), high.alias("high"), begin.alias("begin"), end.alias("end"))

    def places(begin: Column, end: Column, d: Column, equal: bool) -> Column:
        same = lambda i: F.get("iw", i) == F.get("dw", i + d)
        return F.filter(F.sequence(begin, end - 1), same if equal else lambda i: ~same(i))

    def passes(a: Column) -> Column:
        # a window passes where ``width`` places lie between a difference and the one ``allowed + 1`` further on
        ends = F.concat(F.array(a["begin"] - 1), places(a["begin"], a["end"], a["d"], False), F.array_repeat(a["end"], allowed + 1))
        wide = lambda x, y: y - x > width
        return (a["end"] - a["begin"] >= width) & F.exists(F.array(ends), lambda e: F.exists(F.zip_with(e, F.slice(e, allowed + 2, F.size(e)), wide), lambda w: F.coalesce(w, F.lit(False))))

    def better(best: Column, a: Column) -> Column:
        hopeless = F.struct(a["m"], a["d"]) >= best
        told = F.struct((-F.size(places(a["low"], a["high"], a["d"], True))).alias("m"), a["d"].alias("d"))
        return F.when(hopeless, best).when(passes(a), F.least(best, told)).otherwise(best)

    none = F.struct(F.lit(1).alias("m"), F.lit(0).alias("d"))
    top = F.aggregate(F.sort_array(F.transform("diags", bounded)), none, better)
    best = found.select("tkey", "text", "item_id", size.alias("n"), top.alias("top")).filter("top.m < 0")
    return best.select("tkey", "text", "item_id", F.struct("top.m", "top.d", "n").alias("top"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs (key, item_id) of documents and benchmark items that overlap, with the best alignment of each pair.

    Overlap: in ``min(20, words of the item)`` consecutive aligned words at least 80 % are equal (all of them in items
    of fewer than ten words).  matched_words counts the equal words of the whole alignment, doc_word is the document's
    word, from 0, at which the item begins (negative if its beginning is missing), item_words the item's length.

    Texts of any length are lower-cased and split at white space as wholes.  Null and empty texts match nothing, nor do
    items of fewer than five words, which any text may hold by chance.  Of equal pairs from repeated rows the best
    alignment stays, ties going to the first word.  Empty tables give an empty result.  Other columns are ignored.
    """
    with scratch(docs.sparkSession):
        of_text = staged(overlaps(docs, benchmark), "overlaps", kept=True)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64("text").alias("tkey"), "text")
    keyed = rows.join(limited(of_text.select("tkey").distinct()), "tkey", "left_semi")
    told = keyed.join(of_text, ["tkey", "text"]).groupBy("key", "item_id").agg(F.min("top").alias("top"))
    return told.select(F.col("key").alias(key), "item_id", (-F.col("top.m")).cast("long").alias("matched_words"), F.col("top.n").cast("long").alias("item_words"), F.col("top.d").cast("long").alias("doc_word"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item.

    Documents are told apart by their text, so that null and repeated ids do no harm; those with a null or empty text
    stay, long texts are searched as wholes, repeated rows go or stay together, an empty table gives an empty result
    and no column is touched, whatever its name.
    """
    with scratch(docs.sparkSession):
        leaked = limited(staged(overlaps(docs, benchmark).select("tkey").distinct(), "leaks", kept=True))
    keyed = docs.select(packed(docs.columns).alias("rec"), F.xxhash64("text").alias("tkey"))
    return keyed.join(leaked, "tkey", "left_anti").select(*unpacked("rec", docs.columns))
