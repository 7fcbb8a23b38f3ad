"""A lexical index of immutable segments.

Every run that finds something new writes one segment: a row for each document (digest, length, terms and how often each
occurs), postings ordered by term, and by how much the document frequency of each term changes.  Postings are the documents'
rows turned round a block of documents at a time, so a row has a term with all documents of the block that have it, and what
is shuffled and sorted are terms of blocks instead of single occurrences.  Documents that were replaced or are gone get
tombstones; no file of an older segment is touched.  A search reads the row groups that may have its terms, leaves out
what a later tombstone names, and adds up the frequencies.  ``compact`` merges segments of one size tier and drops what is
dead in them, so a posting is rewritten as often as the logarithm of the index.

What a reader sees is the last version of one small table, the manifest; what a run that stopped has written before is no
part of it and goes with the next compaction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.operators import retrieval
from docgrid.operators.staging import cut

if TYPE_CHECKING:
    from docgrid.session import Warehouse

TIER = 4  # segments up to one tier that are merged, and by how much the tiers differ in size
TOKENS, PAIRS = 2**20, 2**21  # tokens that are counted together, and pairs of document and term in a block of postings
PART = 2**20  # tokens of a segment for which its postings get one more file, up to one for each bucket
FEW = 1000  # keys or terms that are constants of a plan, so that scans skip what hasn't them

MANIFEST = "segment long, covers array<long>, postings long, tier int, n long, length long, mean_idf double"
RUNS = "run_id string, segment long, status string, started_at timestamp, finished_at timestamp, items long, done long, failed long"
ITEMS = "run_id string, item string, changed long, gone long, status string, error string"


class SegmentIndex:
    """The index ``name`` of a warehouse over documents with the columns ``key``, ``text`` and ``group`` (run items)."""

    def __init__(self, warehouse: Warehouse, name: str = "lexical", key: str = "clause_id", text: str = "search_text", group: str = "policy_id", tokens: Callable[[Column], Column] = retrieval.tokens):
        self.w, self.spark, self.name, self.key, self.text, self.group, self.tokens = warehouse, warehouse.spark, name, key, text, group, tokens

    def _of(self, part: str) -> str:
        return f"{self.name}_{part}"

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.w.read(self._of(part)) if self.w.has(self._of(part)) else self.spark.createDataFrame([], schema)

    def _append(self, part: str, rows: DataFrame) -> None:
        (self.w.append if self.w.has(self._of(part)) else self.w.write)(self._of(part), rows)

    def manifest(self) -> list:
        """Rows of the segments that are in force: as many as there are tiers, times ``TIER`` at most."""
        return self._read("manifest", MANIFEST).orderBy("segment").collect()

    def runs(self) -> DataFrame:
        """One row per run: status, times, number of items, done and failed ones."""
        return self._read("runs", RUNS)

    def items(self, run_id: str) -> DataFrame:
        return self._read("items", ITEMS).filter(F.col("run_id") == run_id)

    def _tombstones(self, manifest: list) -> DataFrame:
        kind = self.w.read(self._of("docs")).schema["key"].dataType.simpleString()
        covers = sorted({c for m in manifest for c in m["covers"]})
        return self._read("dead", f"key {kind}, before long").filter(F.col("before").isin(covers))

    def _in_force(self, part: str, manifest: list, where: Column | None = None) -> DataFrame:
        rows = self.w.read(self._of(part)).filter(F.col("segment").isin([m["segment"] for m in manifest]))
        return self._alive(rows if where is None else rows.filter(where), manifest)

    def _alive(self, rows: DataFrame, manifest: list) -> DataFrame:
        """Those of ``rows`` (key, segment) that no later tombstone names; what the last run has written meets none."""
        last = max(c for m in manifest for c in m["covers"])
        newest, older = rows.filter(F.col("segment") >= last), rows.filter(F.col("segment") < last)
        if all(m["segment"] >= last for m in manifest):
            return newest
        dead = self._tombstones(manifest).groupBy("key").agg(F.max("before").alias("before"))
        return newest.unionByName(older.join(dead, "key", "left").filter("before IS NULL OR segment >= before").drop("before"))

    def documents(self) -> DataFrame:
        """The documents in force: key, item, digest, dl, terms, times, segment."""
        return self._in_force("docs", self.manifest())

    def _named(self, docs: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(self.text), F.lit(""))
        new = docs.filter(F.col(self.key).isNotNull()).select(F.col(self.key).alias("key"), F.coalesce(F.col(self.group).cast("string"), F.lit("")).alias("item"), text.alias("text"))
        return new.withColumn("digest", F.sha2(F.concat_ws("\n", "item", "text"), 256))

    def _todo(self, new: DataFrame, manifest: list) -> DataFrame:
        """Documents that differ from those in force: key, item, whether it is gone, whether it was there."""
        if not manifest:
            return new.select("key", "item", F.lit(False).alias("gone"), F.lit(False).alias("old"))
        had = self._in_force("docs", manifest).select("key", F.col("item").alias("had_item"), F.col("digest").alias("had"))
        both = new.select("key", "item", "digest").join(had, "key", "full").filter("NOT (digest <=> had)")
        return both.select("key", F.coalesce("item", "had_item").alias("item"), F.col("digest").isNull().alias("gone"), F.col("had").isNotNull().alias("old"))

    def pending(self, docs: DataFrame) -> DataFrame:
        """The items (item) of which ``update`` would change something."""
        return self._todo(self._named(docs), self.manifest()).select("item").distinct()

    def update(self, docs: DataFrame, run_id: str, at: str, check: Callable[[DataFrame], DataFrame] | None = None, resume: bool = False) -> dict:
        """Bring the index to ``docs`` and return the run's row; one without changes writes no segment.

        An item (one value of ``group``) is ``succeeded``, or ``skipped`` where nothing of it is left.  ``check`` may refuse
        items: of (item) rows it returns those with an error; these are ``failed``, keep what they had, and are tried
        again by the next run.  A ``run_id`` that is done returns its row, one that stopped or failed goes on with
        ``resume``.  Documents without tokens have no postings but count; a null text
        or group is empty, a null key no document; ``key`` names a document once.
        """
        known = {r["run_id"]: r.asDict() for r in self.runs().filter(F.col("run_id") == run_id).collect()}
        if run_id in known and (known[run_id]["status"] == "succeeded" or not resume):
            return known[run_id]
        manifest = self.manifest()
        segment = max([0, *(r[0] for r in self.runs().select("segment").collect()), *(c for m in manifest for c in m["covers"])]) + 1
        began = F.to_timestamp(F.lit(at))
        run = {"run_id": run_id, "segment": segment, "status": "running", "items": 0, "done": 0, "failed": 0}
        self._save_run(run, began, None)
        new = self._named(docs)
        todo = cut(self._todo(new, manifest))
        per_item = todo.groupBy("item").agg(F.count(F.when(~F.col("gone"), 1)).alias("changed"), F.count(F.when(F.col("gone"), 1)).alias("gone"))
        refused = check(per_item.select("item")).select("item", "error") if check else self.spark.createDataFrame([], "item string, error string")
        left = new.select("item").distinct().withColumn("left", F.lit(True))
        told = per_item.join(refused, "item", "left").join(left, "item", "left")
        status = F.when(F.col("error").isNotNull(), "failed").when(F.col("left").isNull(), "skipped").otherwise("succeeded")
        told = cut(told.select(F.lit(run_id).alias("run_id"), "item", "changed", "gone", status.alias("status"), F.coalesce("error", F.lit("")).alias("error")))
        counts = told.agg(F.count("*").alias("items"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"), F.sum(F.when(F.col("status") != "failed", F.col("changed") + F.col("gone"))).alias("rows")).first()
        todo = todo.join(told.filter("status = 'failed'").select("item"), "item", "left_anti")
        if counts["rows"]:
            self._write_segment(segment, new.join(todo.filter("NOT gone").select("key"), "key", "left_semi"), todo.filter("old").select("key"), manifest)
        if self.w.has(self._of("items")):
            self.w.replace(self._of("items"), F.col("run_id") == run_id, told)
        else:
            self.w.write(self._of("items"), told)
        run |= {"status": "failed" if counts["failed"] else "succeeded", "items": counts["items"], "failed": counts["failed"], "done": counts["items"] - counts["failed"]}
        self._save_run(run, began, F.to_timestamp(F.lit(at)))
        return {r["run_id"]: r.asDict() for r in self.runs().filter(F.col("run_id") == run_id).collect()}[run_id]

    def _save_run(self, run: dict, began: Column, ended: Column | None) -> None:
        values = {**{k: F.lit(v) for k, v in run.items()}, "started_at": began, "finished_at": F.lit(None) if ended is None else ended}
        fields = [f.strip().split(" ") for f in RUNS.split(",")]
        row = self.spark.range(1).select(*[values[n].cast(t).alias(n) for n, t in fields])
        if self.w.has(self._of("runs")):
            self.w.replace(self._of("runs"), F.col("run_id") == run["run_id"], row)
        else:
            self.w.write(self._of("runs"), row)

    def _write_segment(self, segment: int, fresh: DataFrame, old: DataFrame, manifest: list) -> None:
        here = F.lit(segment).cast("long").alias("segment")
        # dealt and ordered as texts, so that no text is split twice
        words = fresh.repartitionByRange("key").sortWithinPartitions("key").select("key", "item", "digest", self.tokens(F.col("text")).alias("words"))
        self._append("docs", counted(words).select("*", here))
        more = self.w.read(self._of("docs")).filter(F.col("segment") == segment).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        size = self._write_postings(segment, more["length"])
        delta = self.w.read(self._of("postings")).filter(F.col("segment") == segment).select("term", F.col("n").alias("d"))
        less = {"n": 0, "length": 0}
        if manifest:
            gone = self._of_keys(old, manifest)
            less = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
            delta = delta.unionByName(inverted(gone).select("term", (-F.size("keys")).alias("d")))
        delta = delta.groupBy("term").agg(F.sum("d").alias("df")).filter("df <> 0").select("term", retrieval.bucket(F.col("term")).alias("bucket"), "df", here)
        self._append("counts", delta.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term"))
        self._append("dead", old.select("key", here.alias("before")))
        rows = [*([m.asDict() for m in manifest]), {"segment": segment, "covers": [segment], "postings": size}]
        self._publish(rows, (manifest[0]["n"] if manifest else 0) + more["n"] - less["n"], (manifest[0]["length"] if manifest else 0) + more["length"] - less["length"])

    def _write_postings(self, segment: int, length: int) -> int:
        """Turn the documents of a segment, of ``length`` tokens, into its postings; how many these are."""
        post = inverted(self.w.read(self._of("docs")).filter(F.col("segment") == segment)).withColumn("bucket", retrieval.bucket(F.col("term")))
        # files have ranges of buckets; as these are hashes nothing has to be sampled for that
        parts = min(retrieval.BUCKETS, length // PART + 1)
        post = post.repartitionById(parts, (F.col("bucket") * parts / retrieval.BUCKETS).cast("int")).sortWithinPartitions("term")
        self._append("postings", post.select("*", F.size("keys").alias("n"), F.lit(segment).cast("long").alias("segment")))
        return self.w.read(self._of("postings")).filter(F.col("segment") == segment).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _of_keys(self, keys: DataFrame, manifest: list) -> DataFrame:
        """Documents in force of these keys; of a few of them only the row groups that may have them are read."""
        few = [r[0] for r in keys.limit(FEW + 1).collect()]
        return self._in_force("docs", manifest, F.col("key").isin(few)) if len(few) <= FEW else self._in_force("docs", manifest).join(keys, "key", "left_semi")

    def _publish(self, rows: list[dict], n: int, length: int) -> None:
        """Make these segments the index, with the mean of the terms' weights for ``n`` documents."""
        covers = sorted({c for r in rows for c in r["covers"]})
        df = self.w.read(self._of("counts")).filter(F.col("segment").isin([*covers])).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        mean = df.agg(F.avg(F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
        out = [(r["segment"], list(r["covers"]), r["postings"], tier(r["postings"]), n, length, mean) for r in rows]
        self.w.write(self._of("manifest"), self.spark.createDataFrame(out, MANIFEST).coalesce(1))

    def search(self, query: DataFrame, top_k: int = 50) -> DataFrame:
        """(key, bm25_score, bm25_rank) as ``retrieval.bm25`` gives them for the documents in force; with query_id, of each query."""
        ids = [c for c in query.columns if c == "query_id"]
        manifest = self.manifest()
        asked = query.select(*ids, F.explode(self.tokens(F.col("query_text"))).alias("term")).groupBy(*ids, "term").agg(F.count("*").alias("times"))
        if not manifest or not manifest[0]["n"]:
            kind = self.w.read(self._of("docs")).schema["key"].dataType.simpleString() if self.w.has(self._of("docs")) else "string"
            empty = self.spark.createDataFrame([], ", ".join([*[f"{c} {query.schema[c].dataType.simpleString()}" for c in ids], f"`{self.key}` {kind}, bm25_score double, bm25_rank int"]))
            return empty
        n, length, mean = manifest[0]["n"], manifest[0]["length"], manifest[0]["mean_idf"]
        words = [r[0] for r in asked.select("term").distinct().limit(FEW + 1).collect()]
        here = F.col("term").isin(words) if len(words) <= FEW else F.lit(True)
        covers = sorted({c for m in manifest for c in m["covers"]})
        df = self.w.read(self._of("counts")).filter(here & F.col("segment").isin(covers)).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        weights = asked.join(df.select("term", F.when(raw < 0, retrieval.FLOOR * F.lit(mean)).otherwise(raw).alias("idf")), "term")
        blocks = self.w.read(self._of("postings")).filter(here & F.col("segment").isin([m["segment"] for m in manifest]))
        blocks = blocks if len(words) <= FEW else blocks.join(asked.select("term").distinct(), "term", "left_semi")
        each = blocks.select("term", "segment", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("occurs").alias("tf"), F.col("lengths").alias("dl"))).alias("p")).select("term", "segment", "p.*")
        # dealt by document while a term is one row for all queries
        hit = self._alive(each, manifest).repartition("key").join(weights, "term")
        k1, b = retrieval.K1, retrieval.B
        part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(length / n)))
        scored = hit.groupBy(*ids, "key").agg(F.round(F.sum(part), 6).alias("bm25_score")).withColumnRenamed("key", self.key)
        return retrieval.ranked(scored, self.key, "bm25_score", "bm25_rank", top_k, ids)

    def compact(self) -> list[int]:
        """Merge the segments up to the first tier that has ``TIER`` of them, until none has; the numbers of those that went.

        The merged segment takes the largest number, so that later tombstones go on to name its rows, and the rows that
        earlier ones name are dropped.  Only files of the merged segments are replaced.
        """
        went: list[int] = []
        while True:
            manifest = self.manifest()
            upto = [[m for m in manifest if m["tier"] <= t] for t in sorted({m["tier"] for m in manifest})]
            full = next((small for small in upto if len(small) >= TIER), None)
            if full is None:
                return went
            numbers = [m["segment"] for m in full]
            # rows are copied under the new number before the manifest names it; the old ones go when it does
            stays = self._free(manifest)
            rows = self._in_force("docs", manifest, F.col("segment").isin(numbers)).withColumn("segment", F.lit(stays).cast("long"))
            self._append("docs", rows.repartitionByRange("key").sortWithinPartitions("key"))
            length = self.w.read(self._of("docs")).filter(F.col("segment") == stays).agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
            size = self._write_postings(stays, length)
            merged = {"segment": stays, "covers": sorted({c for m in full for c in m["covers"]} | {stays}), "postings": size}
            self._publish([*[m.asDict() for m in manifest if m["segment"] not in numbers], merged], manifest[0]["n"], manifest[0]["length"])
            for part in ("postings", "docs"):
                self.w.delete(self._of(part), F.col("segment").isin(numbers))
            went += numbers

    def _free(self, manifest: list) -> int:
        return max([0, *(r[0] for r in self.runs().select("segment").collect()), *(c for m in manifest for c in m["covers"])]) + 1

    def sweep(self) -> None:
        """Add up the frequencies' changes, and drop tombstones that name nothing and rows of runs that stopped.

        To be called when nobody writes.
        """
        manifest = self.manifest()
        if not manifest:
            return
        numbers, covers = [m["segment"] for m in manifest], sorted({c for m in manifest for c in m["covers"]})
        for part in ("postings", "docs"):
            self.w.delete(self._of(part), ~F.col("segment").isin(numbers))
        self.w.delete(self._of("dead"), ~F.col("before").isin(covers) | (F.col("before") <= min(numbers)))
        counts = self.w.read(self._of("counts")).filter(F.col("segment").isin(covers)).groupBy("term", "bucket").agg(F.sum("df").alias("df")).filter("df <> 0")
        counts = cut(counts.select("term", "bucket", "df", F.lit(max(covers)).cast("long").alias("segment")))
        self.w.write(self._of("counts"), counts.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term"))


def tier(postings: int) -> int:
    """The size tier of a segment: the whole logarithm of its postings to the base ``TIER``."""
    out = 0
    while postings >= TIER:
        postings, out = postings // TIER, out + 1
    return out


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Borders of runs of rows with up to ``most`` values together, or of one row that has more."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end


def _sizes(lists: pa.Array) -> np.ndarray:
    return pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` (key, item, digest, words) with dl, terms and times in the place of words: each term once, and how often it occurs."""
    kind, most = rows.schema["key"].dataType.simpleString(), TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in _slices(_sizes(batch.column(3)), most):
                b = batch.slice(begin, end - begin)
                dl = _sizes(b.column(3))
                codes = b.column(3).flatten().dictionary_encode()
                known = codes.indices.is_valid().to_numpy(zero_copy_only=False)
                pairs = np.sort(np.repeat(np.arange(len(dl)) << 32, dl)[known] | codes.indices.drop_null().to_numpy())
                first = np.flatnonzero(np.diff(pairs, prepend=-1))
                times, pairs = np.diff(first, append=len(pairs)), pairs[first]
                sizes = np.bincount(pairs >> 32, minlength=len(dl))
                terms = codes.dictionary.take(pa.array(pairs & 0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(dl), _lists(sizes, terms), _lists(sizes, pa.array(times, pa.int32()))], ["key", "item", "digest", "dl", "terms", "times"])

    return rows.mapInArrow(run, f"key {kind}, item string, digest string, dl long, terms array<string>, times array<int>")


def inverted(docs: DataFrame) -> DataFrame:
    """(term, keys, occurs, lengths): of each block of ``docs`` the documents that have a term, how often, and how long they are."""
    kind, most = docs.schema["key"].dataType.simpleString(), PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in _slices(_sizes(batch.column(2)), most):
                b = batch.slice(begin, end - begin)
                sizes = _sizes(b.column(2))
                codes = b.column(2).flatten().dictionary_encode()
                code = codes.indices.to_numpy()
                at = np.sort(code.astype(np.int64) << 32 | np.arange(len(code))) & 0xFFFFFFFF  # by term, then as they stand
                of, n = pa.array(np.repeat(np.arange(len(sizes)), sizes)[at]), np.bincount(code, minlength=len(codes.dictionary))
                keys, occurs, lengths = b.column(0).take(of), b.column(3).flatten().take(pa.array(at)), b.column(1).cast(pa.int32()).take(of)
                yield pa.RecordBatch.from_arrays([codes.dictionary, *(_lists(n, x) for x in (keys, occurs, lengths))], ["term", "keys", "occurs", "lengths"])

    return docs.select("key", "dl", "terms", "times").mapInArrow(run, f"term string, keys array<{kind}>, occurs array<int>, lengths array<int>")
