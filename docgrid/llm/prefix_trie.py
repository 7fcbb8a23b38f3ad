"""Prefix trie of conversations by polynomial rolling prefix fingerprints.

Conversations are scanned in the order of their turns, dealt by ranges, so that one conversation can be many tasks.  A
numpy scan gives every prefix its fingerprint, the sum of turn hashes times powers of ``BASE`` modulo 2^64, from which
that of a rebuilt conversation follows by subtraction and a shift of powers.  Equal (depth, fingerprint) are a candidate
node.  A candidate is verified turn by turn: all its members must have their representative's last turn and its parent
node.  Turn hashes are proved to name one (role, text) each; those that name several get numbers.  Candidates in which a
member differs from the representative are split until none is left.

The rollup needs no walk over depths.  A conversation is the representative of a run of nodes that ends with its own end,
so with s the depth where that run begins, and B(d) the bytes of its first d texts, a member whose run begins below a
node of depth d adds B(s - 1) - B(d - 1) to what is saved in the node's subtree, and others add nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import limited, scratch, staged

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
ROUND = 1 << 64
FAMILY, HEAD = 5, 9  # conversations of one family share a beginning; its length is below HEAD
PREFIX = 64  # characters of role and text that decide the range; the order within a range is by all of them
CHUNK = 1 << 12  # members named in one chunk of a digest

NODE = ["depth", "fp", "v"]


def _powers(n: int) -> np.ndarray:
    """BASE to the power of 0, 1, ... n - 1."""
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and inclusive prefixes of turns within the part of a conversation that this partition has."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    last, count, sum_, bytes_, power = None, 0, np.uint64(0), 0, _powers(1024)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        t, size = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
        n = len(conv)
        starts = np.flatnonzero(np.concatenate(([conv[0] != last], conv[1:] != conv[:-1])))
        # what the rows of the conversation that goes on from the batch before have had
        at = np.arange(n)
        begin = np.zeros(n, np.int64)
        begin[starts] = starts
        begin = np.maximum.accumulate(begin)
        goes_on = at < (starts[0] if len(starts) else n)
        idx = np.where(goes_on, at + count, at - begin)
        if idx.max() >= len(power):
            power = _powers(int(idx.max()) * 2)
        p, b = np.cumsum(t * power[idx], dtype=np.uint64), np.cumsum(size)
        p0, b0 = np.concatenate((np.zeros(1, np.uint64), p)), np.concatenate(([0], b))
        p = p - p0[begin] + np.where(goes_on, sum_, np.uint64(0))
        b = b - b0[begin] + np.where(goes_on, bytes_, 0)
        last, count, sum_, bytes_ = conv[-1], int(idx[-1]) + 1, p[-1], int(b[-1])
        arrays = [conv, np.full(n, pid), idx, t.view(np.int64), size, p.view(np.int64), b]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["conv_id", "pid", "i", "t", "size", "p", "b"])


def _moved(starts: dict[tuple[int, int], tuple[int, int, int]]):
    """Parts of a conversation that lies in several partitions are moved behind one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = _powers(1024)
        for batch in batches:
            conv, pid, i, t, size, p, b = (batch.column(k).to_numpy() for k in range(7))
            i, p, b = i.copy(), p.view(np.uint64).copy(), b.copy()
            if i.max(initial=0) >= len(power):
                power = _powers(int(i.max()) * 2)
            before, present = p - t.view(np.uint64) * power[i], set(np.unique(pid).tolist())
            for c, q in [k for k in starts if k[1] in present]:
                rows = (conv == c) & (pid == q)
                n, p0, b0 = starts[c, q]
                up = np.uint64(pow(BASE, n, ROUND))
                i[rows] += n
                p[rows] = p[rows] * up + np.uint64(p0)
                before[rows] = before[rows] * up + np.uint64(p0)
                b[rows] += b0
            arrays = [conv, i, t, size, p.view(np.int64), before.view(np.int64), b - size]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["conv_id", "i", "t", "size", "p", "p0", "b0"])

    return run


def turns_of(conversations: DataFrame, turn_bits: int = 64) -> DataFrame:
    """Rows conv_id, i (0, 1, ... in order of turns), t (hash of the turn), size (bytes of its text), p and p0 (fingerprint
    with and without it), b0 (bytes before it), and k, which tells turns of one hash apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    hash_ = F.xxhash64("role", F.length("role"), "text")
    rows = rows.withColumn("t", hash_ if turn_bits == 64 else F.pmod(hash_, F.lit(1 << turn_bits)))
    whole = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX)).sortWithinPartitions(*whole)
    scanned = dealt.select("conv_id", "t", F.octet_length("text").cast("long").alias("size")).mapInArrow(_scan, "conv_id long, pid long, i long, t long, size long, p long, b long")
    scanned = staged(scanned, "scanned")
    # at most two parts a partition are of conversations that lie in several
    parts = scanned.groupBy("conv_id", "pid").agg(F.max("i").alias("i"), F.max_by("p", "i").alias("p"), F.max("b").alias("b"))
    spread = parts.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("pid", "i", "p", "b"))).alias("parts")).filter("n > 1")
    starts = {}
    for row in spread.collect():
        n, p, b = 0, 0, 0
        for part in row["parts"]:
            if n:
                starts[row["conv_id"], part["pid"]] = (n, p, b)
            p, b, n = (p + part["p"] * pow(BASE, n, ROUND)) % ROUND, b + part["b"], n + part["i"] + 1
    out = scanned.mapInArrow(_moved(starts), "conv_id long, i long, t long, size long, p long, p0 long, b0 long")
    # turns of one hash are one turn, or get numbers
    turn = F.struct("role", "text")
    several = staged(rows.groupBy("t").agg(F.min(turn).alias("low"), F.max(turn).alias("high")).filter("low <> high").select("t"), "hashes")
    if several.isEmpty():
        return out.withColumn("k", F.lit(0))
    names = rows.join(F.broadcast(several), "t").select("t", "role", "text").distinct().withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy("role", "text")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    which = rows.withColumn("i", place.cast("long")).join(names, ["t", "role", "text"]).select("conv_id", "i", "k")
    return out.join(which, ["conv_id", "i"], "left").withColumn("k", F.coalesce("k", F.lit(0)))


def _shifted(bits: int):
    """Fingerprints of rebuilt conversations: own turns are put behind the family's."""
    back = np.array([pow(BASE, -k, ROUND) for k in range(HEAD)], np.uint64)
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(k).to_numpy() for k, n in enumerate(batch.schema.names)}
            shift, start, own = back[col["gap"]], col["start"].view(np.uint64), col["own"].view(np.uint64)
            fp, pfp = (((start + (col[n].view(np.uint64) - own) * shift) & mask).view(np.int64) for n in ("p", "p0"))
            fp, pfp = np.where(col["depth"] == 0, 0, fp), np.where(col["depth"] <= 1, 0, pfp)
            arrays = [col["conv_id"], col["depth"], fp, pfp, col["t"], col["k"], col["size"], col["b0"]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["conv_id", "depth", "fp", "pfp", "t", "k", "size", "b0"])

    return run


def rebuilt(turns: DataFrame, bits: int = 64) -> DataFrame:
    """Rows of the rebuilt conversations: conv_id, depth, fp and pfp (of the prefix with and without the turn), t, k, size,
    b0 (bytes before the turn); depth 0 once a conversation.

    The first h turns of the family's conversation, then the own turns after the first h.
    """
    head = F.when(F.col("i") < HEAD - 1, F.struct("i", "t", "k", "size", "p", "p0", "b0"))
    heads = staged(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(head)).alias("head")), "heads")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    base = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("first"))
    each = heads.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"), F.col("head").alias("mine")).join(base, "base", "left")
    each = each.withColumn("first", F.slice(F.coalesce("first", F.array().cast(each.schema["first"].dataType)), 1, F.col("h")))

    def end(array: str, length: Column, field: str) -> Column:
        # the array's first `length` turns: their fingerprint or bytes
        turn = F.try_element_at(array, F.greatest(length, F.lit(1)))
        return F.when(length > 0, turn["p"] if field == "p" else turn["b0"] + turn["size"]).otherwise(F.lit(0))

    each = staged(
        each.select(
            "conv_id", "h", "first", F.size("first").alias("n"), end("first", F.size("first"), "p").alias("start"), end("first", F.size("first"), "b").alias("start_b"),
            F.coalesce(end("mine", F.col("h"), "p"), F.lit(0)).alias("own"), F.coalesce(end("mine", F.col("h"), "b"), F.lit(0)).alias("own_b"),
        ),
        "families",
    )
    zero = F.lit(0).cast("long")
    same = [zero.alias("start"), zero.alias("own"), F.lit(0).alias("gap")]
    top = each.select("conv_id", zero.alias("depth"), *[zero.alias(n) for n in ("t", "p", "p0", "size", "b0")], F.lit(0).alias("k"), *same)
    shared = each.select("conv_id", F.explode("first").alias("r"))
    shared = shared.select("conv_id", (F.col("r.i") + 1).alias("depth"), *[F.col(f"r.{n}") for n in ("t", "p", "p0", "size", "b0", "k")], *same)
    own = turns.join(each.drop("first"), "conv_id").filter("i >= h")
    own = own.select(
        "conv_id", (F.col("n") + F.col("i") - F.col("h") + 1).alias("depth"), "t", "p", "p0", "size", (F.col("b0") - F.col("own_b") + F.col("start_b")).alias("b0"), "k",
        "start", "own", (F.col("h") - F.col("n")).alias("gap"),
    )
    rows = top.unionByName(shared).unionByName(own)
    return rows.mapInArrow(_shifted(bits), "conv_id long, depth long, fp long, pfp long, t long, k int, size long, b0 long")


_LIKE = ["pfp", "pv", "t", "k"]  # parent and last turn


def verified(rows: DataFrame) -> DataFrame:
    """``rows`` staged with v: two rows are of one node if and only if depth, fp and v are equal."""
    rows = staged(rows.select("*", F.lit(0).alias("v"), F.lit(0).alias("pv")), "prefixes")
    while True:
        groups = rows.groupBy(*NODE).agg(*[F.min(c).alias(f"low_{c}") for c in _LIKE], *[F.max(c).alias(f"high_{c}") for c in _LIKE])
        mixed = staged(groups.filter(" OR ".join(f"low_{c} <> high_{c}" for c in _LIKE)).select(*NODE), "mixed")
        if mixed.isEmpty():
            return rows
        # members that are not as the representative leave the node, and children follow their parents
        like = rows.join(limited(mixed), NODE).groupBy(*NODE).agg(F.min_by(F.struct(*_LIKE), "conv_id").alias("like"))
        out = rows.join(limited(staged(like, "like")), NODE, "left")
        out = out.withColumn("v", F.col("v") + F.when(F.col("like").isNotNull() & (F.struct(*_LIKE) != F.col("like")), 1).otherwise(0)).drop("like", "pv")
        out = staged(out, "split")
        parent = out.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("v").alias("pv"))
        rows = staged(out.join(parent, ["conv_id", "depth"], "left").withColumn("pv", F.coalesce("pv", F.lit(0))).select(*rows.columns), "prefixes")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in ascending order, comma-joined in chunks of one node each."""
    for batch in batches:
        depth, fp, v, conv = (batch.column(k).to_numpy() for k in range(4))
        new = np.flatnonzero(np.concatenate(([True], (depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1]) | (v[1:] != v[:-1])))) if len(conv) else np.zeros(0, int)
        cuts = sorted({*new.tolist(), *range(0, len(conv), CHUNK)})
        text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(conv)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(depth[cuts]), pa.array(fp[cuts]), pa.array(v[cuts]), pa.array(conv[cuts]), pa.array(text, pa.string())], names=[*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come in order."""
    names, node, hash_ = [*NODE, "ends_sha256"], None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids")), strict=True):
            if key == node:
                hash_.update(b"," + ids.encode())
                continue
            if node:
                done.append((*node, hash_.hexdigest()))
            node, hash_ = key, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=names)
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((*node, hash_.hexdigest()), (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """ends_sha256 of the nodes at which conversations end.

    Members are dealt by ranges and put into chunks first, so the task that hashes a node reads chunks, not members.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = ends.select(*NODE, "conv_id").repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_runs, "depth long, fp long, v int, first long, ids string")
    return chunks.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(_digests, "depth long, fp long, v int, ends_sha256 string")


def prefix_trie(conversations: DataFrame, bits: int = 64, turn_bits: int = 64) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 and last_bytes (bytes of the node's last text).

    Turns are ordered by turn (null first), ties by role and text; a null role or text is empty; repeated rows are turns
    of their own; rows without conv_id belong to no conversation; a negative id's family is SQL's ``c - c % 5``.  An empty
    table gives an empty result; other columns are ignored.  ``bits`` and ``turn_bits`` narrow the fingerprints and turn
    hashes, which changes how many candidates are split but no result.
    """
    with scratch(conversations.sparkSession):
        rows = verified(rebuilt(turns_of(conversations, turn_bits), bits))
        nodes = staged(
            rows.groupBy(*NODE).agg(
                F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("size").alias("last_bytes"), F.min("b0").alias("b0"), F.min("pfp").alias("pfp"), F.min("pv").alias("pv")
            ),
            "nodes",
        )
        runs = nodes.groupBy("conv_id").agg(F.min("depth").alias("s"), F.max("depth").alias("e"), F.min("b0").alias("b_s"))
        convs = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("fp", "depth").alias("fp"), F.max_by("v", "depth").alias("v"), F.max(F.col("b0") + F.col("size")).alias("b_all"))
        convs = staged(convs.join(runs, "conv_id", "left"), "conversations")
        # a run's first node hangs on a node of another run; the others on the node before them
        firsts = nodes.join(runs.select("conv_id", F.col("s").alias("depth")), ["conv_id", "depth"]).filter("depth > 0")
        root = nodes.filter("depth = 0").select("conv_id").first()
        above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("pfp"), F.col("v").alias("pv"), F.col("conv_id").alias("above"))
        hung = firsts.filter("depth > 1").join(above.filter("depth > 1"), ["depth", "pfp", "pv"]).select("depth", "pfp", "pv", "conv_id", "above")
        hung = staged(hung.unionByName(firsts.filter("depth = 1").select("depth", "pfp", "pv", "conv_id", F.lit(root and root["conv_id"]).cast("long").alias("above"))), "hung")
        branches = hung.groupBy((F.col("depth") - 1).alias("depth"), F.col("pfp").alias("fp"), F.col("pv").alias("v")).agg(F.count("*").alias("branches"))
        placed = nodes.join(branches, NODE, "left").join(hung.select("depth", "conv_id", "above"), ["depth", "conv_id"], "left").join(runs.select("conv_id", "s", "e"), "conv_id")
        placed = placed.withColumn("n_children", F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("e")).cast("long"))
        placed = staged(placed.withColumn("parent_conv_id", F.when(F.col("depth") > F.col("s"), F.col("conv_id")).otherwise(F.col("above"))), "placed")
        leaves = placed.filter("n_children = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"))
        saves = F.when(F.col("s").isNull(), F.col("b_all")).otherwise(F.col("b_s"))
        facts = convs.select("conv_id", saves.alias("until")).join(leaves, "conv_id", "left")
        saved = F.greatest(F.col("until") - F.col("b0"), F.lit(0))
        sums = rows.join(facts, "conv_id").groupBy(*NODE).agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
        nothing = hashlib.sha256(b"").hexdigest()
        out = placed.join(sums, NODE).join(end_digests(convs), NODE, "left")
        return staged(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "last_bytes"), "trie", kept=True)
