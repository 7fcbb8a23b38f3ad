"""Lexical and vector retrieval, rank fusion, reranking and evidence selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.text import keyword_score
from docgrid.operators.staging import cut, pack, spread, unpacked

K1, B, FLOOR = 1.5, 0.75, 0.25
RRF_K = 60
TOKEN = r"[a-z0-9\x{00C0}-\x{024F}]+|[\x{4e00}-\x{9fff}]"


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, and single CJK characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): one row for each term of a document."""
    words = docs.select(F.col(key), tokens(F.col(text)).alias("w")).select(key, F.explode("w").alias("term"), F.size("w").alias("dl"))
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def idf(post: DataFrame, n_docs: Column) -> DataFrame:
    """(term, idf): negative values become a quarter of the mean over the whole vocabulary."""
    df = post.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("idf").alias("mean_idf"))
    return df.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))


def bm25(docs: DataFrame, query: DataFrame, top_k: int = 50, key: str = "doc_id", text: str = "text", words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(key, bm25_score, bm25_rank) of the best documents for the one-row table ``query`` (column query_text).

    A query term counts as often as it occurs; documents that share no term with the query aren't returned.  With a
    column query_id every row is a query of its own, and the result has the best documents of each query_id.  ``words``
    gives the terms of a text.
    """
    ids = [c for c in query.columns if c == "query_id"]
    split, words = words, docs.select(F.col(key), words(F.col(text)).alias("w"))
    wanted = query.select(*ids, F.explode(split(F.col("query_text"))).alias("term")).groupBy(*ids, "term").agg(F.count("*").alias("times"))
    # one pass counts everything about the corpus: document frequencies combine before their shuffle, and the empty term,
    # which every document gets, has the number of documents and their lengths
    each = words.select(F.explode(F.concat(F.array_distinct("w"), F.array(F.lit("")))).alias("term"), F.size("w").alias("dl")).filter(F.col("term").isNotNull())
    df = each.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"))
    every = F.col("term") == ""
    size = df.agg(F.max(F.when(every, F.col("df"))).alias("n"), F.max(F.when(every, F.col("total") / F.col("df"))).alias("avgdl"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = df.crossJoin(F.broadcast(size)).agg(F.first("n").alias("n"), F.first("avgdl").alias("avgdl"), F.avg(F.when(~every, raw)).alias("mean_idf"))
    weights = df.join(F.broadcast(wanted.select("term").distinct()), "term").crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(raw < 0, FLOOR * F.col("mean_idf")).otherwise(raw).alias("idf"))
    # as many rows as the queries have terms
    hit = words.select(key, F.explode("w").alias("term"), F.size("w").alias("dl")).join(F.broadcast(weights), "term")
    hit = hit.groupBy(key, "term", "dl", "idf", "avgdl").agg(F.count("*").alias("tf")).join(F.broadcast(wanted), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hit.groupBy(*ids, key).agg(F.round(F.sum(part), 6).alias("bm25_score"))
    return ranked(scored, key, "bm25_score", "bm25_rank", top_k, ids)


ROWS = 4_096  # documents that meet queries at a time
CELLS = 1 << 21  # of a product of documents and queries, and of its sides


def _bags():
    """The documents of a batch as (key, length) and their terms as (row, number of the term, tf), with the terms, packed.

    Rows of one key, which come one after the other, stay in one batch.
    """

    def packed_bag(table: pa.Table) -> pa.RecordBatch:
        lists = table.column(1).combine_chunks()
        coded, size = pc.dictionary_encode(lists.flatten()), pc.list_value_length(lists)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(size, 0).to_numpy(zero_copy_only=False))
        code, there = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(coded.indices).to_numpy(zero_copy_only=False)
        cell, tf = np.unique((row << 32 | code)[there], return_counts=True)
        parts = [
            pa.record_batch([table.column(0).combine_chunks(), pa.array(size, pa.int32())], ["key", "dl"]),
            pa.record_batch([pa.array((cell >> 32).astype(np.int32)), pa.array((cell & 0xFFFFFFFF).astype(np.int32)), pa.array(tf.astype(np.int32))], ["row", "term", "tf"]),
            pa.record_batch([coded.dictionary], ["term"]),
        ]
        return pa.record_batch([pa.array([pack(b)], pa.binary()) for b in parts], ["docs", "tfs", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                here = pa.Table.from_batches([batch.slice(begin, ROWS)])
                held = here if held is None else pa.concat_tables([held, here])
                keys = held.column(0)
                if keys[0] == keys[-1] or keys[0].as_py() is None and keys[-1].as_py() is None:
                    continue
                whole = len(keys) - 1
                while keys[whole - 1] == keys[-1]:
                    whole -= 1
                yield packed_bag(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield packed_bag(held)

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, ...]]:
    for b in batches:
        for k in range(b.num_rows):
            yield tuple(next(unpacked([pa.record_batch([b.column(i).slice(k, 1)], ["rows"])])) for i in range(3))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, total) of each batch of documents; the empty term has their number and lengths."""
    for docs, tfs, terms in _opened(batches):
        df = np.bincount(tfs.column(1).to_numpy(), minlength=terms.num_rows)
        total = pc.sum(docs.column(1)).as_py() or 0
        n = docs.num_rows - docs.column(1).null_count
        yield pa.record_batch([pa.array([*terms.column(0).to_pylist(), ""], pa.string()), pa.array([*df.tolist(), n]), pa.array([0] * len(df) + [total])], ["term", "df", "total"])


def _best(asked: pa.Table, terms: list[str], idf: np.ndarray, avgdl: float, top_k: int, kind: pa.DataType):
    """The ``top_k`` best of a task's documents for each query; ``asked`` has (query, term, times) as numbers, by query."""
    query, term, times = (asked.column(k).to_numpy() for k in range(3))
    most = int(query[-1]) + 1 if len(query) else 0
    number = {t: k for k, t in enumerate(terms)}
    positive = bool((idf > 0).all())  # a score above zero then says that a term is shared

    def kept(of: np.ndarray, score: np.ndarray, keys: pa.Array) -> np.ndarray:
        place = pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.lexsort((place, -score, of))
        sorted_of = of[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_of[1:] != sorted_of[:-1])))
        return order[np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of)))) < top_k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.full(most, -np.inf)  # scores below it have top_k better ones
        of, score, keys, waiting = np.empty(0, np.int64), np.empty(0), pa.array([], kind), []

        def settled() -> None:
            nonlocal of, score, keys
            of, score = np.concatenate([of, *(w[0] for w in waiting)]), np.concatenate([score, *(w[1] for w in waiting)])
            keys = pa.concat_arrays([keys, *(w[2] for w in waiting)])
            waiting.clear()
            at = kept(of, score, keys) if len(of) else np.empty(0, np.int64)
            of, score, keys = of[at], score[at], keys.take(pa.array(at))
            n = np.bincount(of, minlength=most)
            last = np.cumsum(n) - 1
            full = n == top_k
            edge[full] = score[last[full]]

        for docs, tfs, words in _opened(batches):
            # terms of the queries only; of rows with one key that are as long, occurrences are added up
            at = np.array([number.get(w, -1) for w in words.column(0).to_pylist()], np.int64)
            row, code, tf = tfs.column(0).to_numpy(), at[tfs.column(1).to_numpy()], tfs.column(2).to_numpy()
            row, code, tf = row[code >= 0], code[code >= 0], tf[code >= 0]
            if not len(row):
                continue
            coded = pc.dictionary_encode(docs.column(0), null_encoding="encode")
            doc, names, dl = coded.indices.to_numpy().astype(np.int64)[row], coded.dictionary, docs.column(1).to_numpy()[row]
            order = np.lexsort((dl, code, doc))
            doc, code, dl, tf = doc[order], code[order], dl[order], tf[order]
            new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]) | (dl[1:] != dl[:-1]))))
            doc, code, dl, tf = doc[new], code[new], dl[new], np.add.reduceat(tf, new)
            part = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            some = np.unique(code)
            # of the queries as many at a time as keep the sides of the product bounded, and of the documents the same
            wide = max(1, min(most, CELLS // max(len(some), ROWS)))
            for begin in range(0, most, wide):
                end = min(begin + wide, most)
                a, b = np.searchsorted(query, (begin, end))
                used = np.intersect1d(some, term[a:b])
                if not len(used):
                    continue
                column = np.full(len(terms), -1, np.int64)
                column[used] = np.arange(len(used))
                there = column[term[a:b]] >= 0
                side = np.zeros((end - begin, len(used)))
                side[query[a:b][there] - begin, column[term[a:b]][there]] = times[a:b][there]
                high = max(1, CELLS // max(len(used), end - begin))
                for top in range(0, len(names), high):
                    c, d = np.searchsorted(doc, (top, top + high))
                    hits = column[code[c:d]] >= 0
                    where = doc[c:d][hits] - top, column[code[c:d]][hits]
                    left = np.zeros((min(high, len(names) - top), len(used)))
                    np.add.at(left, where, part[c:d][hits])
                    said = side @ left.T
                    shared = said > 0
                    if not positive:
                        left[:] = 0
                        left[where] = 1
                        shared = (side > 0).astype(float) @ left.T > 0
                    said = np.floor(said * 1e6 + 0.5) / 1e6
                    if not (edge[begin:end] > -np.inf).all() and said.shape[1] > top_k:
                        least = np.partition(np.where(shared, said, -np.inf), -top_k, axis=1)[:, -top_k]
                        shared &= said >= np.maximum(edge[begin:end], least)[:, None]
                    else:
                        shared &= said >= edge[begin:end, None]
                    q, at = np.nonzero(shared)
                    if len(q):
                        found = names.take(pa.array(at))
                        if len(q) > 2 * top_k * (end - begin):
                            first = kept(q, said[q, at], found)
                            q, at, found = q[first], at[first], found.take(pa.array(first))
                        waiting.append((q + begin, said[q, at], found))
                if sum(len(w[0]) for w in waiting) > CELLS // 4:
                    settled()
            settled()
        yield pa.record_batch([pa.array(of, pa.int64()), keys, pa.array(score)], ["query", "key", "bm25_score"])

    return run


def bm25_each(docs: DataFrame, queries: DataFrame, top_k: int = 50, key: str = "doc_id", text: str = "text", words: Callable[[Column], Column] = tokens) -> DataFrame:
    """``bm25`` for queries (query_id, query_text) that grow with the documents.

    Documents are dealt by key, split once and stored as packed bags of terms.  A bag meets all queries in bounded dense
    products, and a task gives the ``top_k`` best of each query only, so nothing that is shuffled or stored grows as
    queries times documents; the work does.  The driver holds the queries' terms, and the weight of each.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, asked_kind = docs.schema[key].dataType, queries.schema["query_id"].dataType
    dealt = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").sortWithinPartitions("key")
    bags = cut(dealt.select("key", words(F.col("text")).alias("w")).mapInArrow(_bags(), "docs binary, tfs binary, terms binary"))
    wanted = queries.select("query_id", F.explode(words(F.col("query_text"))).alias("term")).filter(F.col("term").isNotNull()).groupBy("query_id", "term").agg(F.count("*").alias("times")).toArrow()
    df = cut(bags.mapInArrow(_frequencies, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))
    size = df.filter("term = ''").first()
    n, avgdl = (size["df"], size["total"] / size["df"]) if size else (0, 0.0)
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = df.filter("term <> ''").agg(F.avg(raw)).first()[0]
    weights = df.join(docs.sparkSession.createDataFrame(pa.table({"term": pc.unique(wanted.column("term"))})), "term").filter("term <> ''").select("term", F.when(raw < 0, FLOOR * F.lit(mean)).otherwise(raw).alias("idf")).orderBy("term").toArrow()
    terms = weights.column("term").to_pylist()
    number = pc.index_in(wanted.column("term"), pa.array(terms, pa.string()))
    coded = wanted.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    numbers = pa.table({"query": coded.indices.cast(pa.int64()), "term": number.combine_chunks().cast(pa.int64()), "times": wanted.column("times").combine_chunks()})
    numbers = numbers.filter(pc.is_valid(numbers.column("term"))).sort_by("query")
    ids = coded.dictionary
    best = _best(numbers, terms, weights.column("idf").to_numpy(), float(avgdl), top_k, to_arrow_type(kind))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in best(batches):
            yield pa.record_batch([ids.take(b.column(0)), b.column(1), b.column(2)], ["query_id", key, "bm25_score"])

    scored = bags.mapInArrow(named, f"query_id {asked_kind.simpleString()}, `{key}` {kind.simpleString()}, bm25_score double")
    return ranked(scored, key, "bm25_score", "bm25_rank", top_k, ["query_id"])


BUCKETS = 256


def bucket(term: Column) -> Column:
    """The part of a stored index that has the term."""
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def ranked(scored: DataFrame, key: str, score: str, rank: str, top_k: int, ids: list[str] | None = None) -> DataFrame:
    """The ``top_k`` best rows (of each of ``ids``) with their rank; ties go to the smaller key.

    Without ids the window sees ``top_k`` rows only.
    """
    if ids:
        return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*ids).orderBy(F.col(score).desc(), F.col(key)))).filter(F.col(rank) <= top_k)
    best = scored.orderBy(F.col(score).desc(), F.col(key)).limit(top_k)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(key))))


def vector_search(vectors: DataFrame, query: DataFrame, top_k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity, vector_rank) of the nearest vectors to the one-row table ``query`` (column query_vector).

    Exact: every vector is compared, a batch of them in one product.  Null vectors and those of another length have no
    similarity and aren't returned.  With a column query_id every row is a query of its own, and the result has the nearest
    vectors of each query_id.
    """
    if "query_id" in query.columns:
        from docgrid.operators.vectors import search_exact

        return search_exact(vectors, query, top_k, key, vector)
    asked = query.select("query_vector").first()
    q = np.asarray(asked[0] if asked and asked[0] is not None else [], np.float64)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = max(float(np.linalg.norm(q)), 1e-300)
        for b in batches:
            b = b.filter(pc.equal(pc.list_value_length(b.column(1)), len(q)))
            if not b.num_rows or not len(q):
                continue
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, len(q))
            similarity = m @ q / np.maximum(np.linalg.norm(m, axis=1) * length, 1e-300)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(similarity)], [key, "similarity"])

    scored = vectors.select(key, vector).mapInArrow(run, f"`{key}` {kind}, similarity double")
    return ranked(scored.select(key, F.round("similarity", 6).alias("similarity")), key, "similarity", "vector_rank", top_k)


def rrf(lists: list[tuple[DataFrame, str]], key: str, top_k: int = 100, k: int = RRF_K) -> DataFrame:
    """(key, rrf_score): sum of 1 / (k + rank) over ranked lists, given as tables and their rank columns."""
    rows = reduce(DataFrame.unionByName, [t.select(key, (1.0 / (k + F.col(r))).alias("part")) for t, r in lists])
    return rows.groupBy(key).agg(F.round(F.sum("part"), 8).alias("rrf_score")).orderBy(F.desc("rrf_score"), key).limit(top_k)


def candidate_k(k: int) -> int:
    """How many candidates each list gives for ``k`` results."""
    return min(100, max(50, 5 * k))


def rerank(candidates: DataFrame, query: Column, top_k: int, key: str = "clause_id", text: str = "search_text", fusion: bool = False) -> DataFrame:
    """Best row of each key, by score; ``candidates`` has similarity, rrf_score and the text.

    The score is the fusion score, or similarity and keyword score together.
    """
    c = candidates.withColumn("keyword_score", keyword_score(query, F.col(text)))
    c = c.withColumn("score", F.bround(F.coalesce("rrf_score", F.lit(0.0)), 8) if fusion else F.bround(F.coalesce("similarity", F.lit(0.0)) + F.col("keyword_score"), 6))
    order = [F.desc("score"), F.coalesce("rrf_score", F.lit(0.0)).desc(), F.coalesce("similarity", F.lit(0.0)).desc(), F.desc("keyword_score"), F.col(key)]
    first = c.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
    return first.orderBy(*order).limit(top_k)


def assertion_boost(candidates: DataFrame, matches: DataFrame, key: str = "clause_id", weight: float = 0.2) -> DataFrame:
    """Candidates with score raised by up to ``weight`` for the best matching assertion of their clause."""
    best = matches.groupBy(key).agg(F.max("similarity").alias("assertion_score"))
    joined = candidates.join(best, key, "left")
    boost = F.least(F.lit(weight), weight * F.coalesce("assertion_score", F.lit(0.0)))
    return joined.withColumn("score", F.round(F.col("score") + boost, 6))


def select_evidence(candidates: DataFrame, max_evidence: int = 8, max_documents: int = 3, max_per_document: int = 3, document: str = "policy_id", clause: str = "clause_id", order: str = "rank") -> DataFrame:
    """The first clauses of the first documents in rank order, each clause once.

    ``candidates`` is a bounded ranked list, so the windows without partitions see few rows.
    """
    c = candidates.withColumn("__one", F.row_number().over(Window.partitionBy(clause).orderBy(order))).filter("__one = 1").drop("__one")
    c = c.withColumn("__first", F.min(order).over(Window.partitionBy(document)))
    c = c.withColumn("document_rank", F.dense_rank().over(Window.orderBy("__first"))).filter(F.col("document_rank") <= max_documents)
    c = c.withColumn("clause_rank", F.row_number().over(Window.partitionBy(document).orderBy(order))).filter(F.col("clause_rank") <= max_per_document)
    return c.withColumn("evidence_no", F.row_number().over(Window.orderBy(order))).filter(F.col("evidence_no") <= max_evidence).drop("__first")
