"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docgrid.functions.text import keyword_score
from docgrid.operators import retrieval as R
from docgrid.operators import segmenter
from docgrid.operators.segments import SegmentIndex
from docgrid.operators.vectors import InvertedFile

from .common import scratch_house, table


def _query(spark, sf_dir, item=0):
    return table(spark, sf_dir, "benchmark").filter(F.col("item_id") == item).select(F.col("text").alias("query_text"))


def _short_query(spark, sf_dir):
    """The shortest benchmark item, as a question."""
    b = table(spark, sf_dir, "benchmark")
    return b.orderBy(F.length("text"), "item_id").limit(1).select(F.col("text").alias("q"))


def _vector(spark, sf_dir, vec=0):
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec).select(F.col("embedding").alias("query_vector"))


def bm25_topk(spark, sf_dir):
    return R.bm25(table(spark, sf_dir, "documents"), _query(spark, sf_dir), 50)


def vector_topk(spark, sf_dir):
    return R.vector_search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 50)


def bm25_topk_each(spark, sf_dir):
    """Every benchmark item whose id is divisible by 20 as a query."""
    q = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return R.bm25(table(spark, sf_dir, "documents"), q, 50)


def vector_topk_each(spark, sf_dir):
    """Every vector whose id is divisible by 20 as a query."""
    e = table(spark, sf_dir, "embeddings")
    return R.vector_search(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 50)


def ivf_topk_each(spark, sf_dir):
    """The same queries by the inverted file, which looks into as many cells as it has measured to be needed."""
    e = table(spark, sf_dir, "embeddings")
    index = InvertedFile(scratch_house(spark))
    index.build(e)
    return index.search(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 50)


def indexed_topk_each(spark, sf_dir):
    """The queries of ``bm25_topk_each`` by the stored index, which grew in three runs and a compaction.

    First the documents of English alone, with their texts doubled, then all as they are, then nothing new.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    q = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    index = SegmentIndex(scratch_house(spark), "documents", "doc_id", "text", "source")
    index.update(docs.filter("lang = 'en'").withColumn("text", F.concat_ws(" ", "text", "text")), "first", "2024-01-01 00:00:00")
    index.update(docs, "second", "2024-01-02 00:00:00")
    index.update(docs, "third", "2024-01-03 00:00:00")
    index.compact()
    return index.search(q, 50)


#: Latin letters as CJK characters, so that conversations are runs of words without spaces.
AS_CJK = "".join(chr(0x4E00 + 7 * k) for k in range(26))


def segmented_topk(spark, sf_dir):
    """Conversations written without spaces in CJK characters, segmented by what they teach, for the first words of each
    conversation whose id is divisible by 20."""
    c = table(spark, sf_dir, "conversations")
    plain = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz ", AS_CJK)
    docs = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), plain.alias("text"))
    tokens = segmenter.tokenizer(segmenter.learn(docs, words=500))
    asked = c.filter("conv_id % 20 = 0 AND turn = 0").select(F.col("conv_id").alias("query_id"), plain.alias("query_text"))
    return R.bm25_each(docs, asked, 10, words=tokens)


def hybrid_search(spark, sf_dir):
    """Lexical and vector lists fused by reciprocal ranks."""
    lexical = R.bm25(table(spark, sf_dir, "documents"), _query(spark, sf_dir), 50).withColumnRenamed("doc_id", "id")
    near = R.vector_search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 50).withColumnRenamed("vec_id", "id")
    return R.rrf([(near, "vector_rank"), (lexical, "bm25_rank")], "id", 20)


def bm25_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    post = R.postings(docs, "doc_id", "text")
    return R.idf(post, F.lit(docs.count())).select("term", F.round("idf", 6).alias("idf"))


def keyword_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(_short_query(spark, sf_dir)))
    return docs.select("doc_id", keyword_score(F.col("q"), F.col("text")).alias("keyword_score"))


def assertion_boost(spark, sf_dir):
    """Orders as candidates, the lines' discounts as similarities of matched assertions."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clause_id"), (F.col("o_totalprice") / 1e6).alias("score"))
    m = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("clause_id"), (F.col("l_discount") * 12).alias("similarity"))
    return R.assertion_boost(o, m).select("clause_id", "score", F.round("assertion_score", 6).alias("assertion_score"))


def evidence_selection(spark, sf_dir):
    """Best documents by length as ranked clauses, their sources as documents."""
    c = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(30)
    c = c.select(F.col("source").alias("policy_id"), F.col("doc_id").alias("clause_id"), F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return R.select_evidence(c).select("policy_id", "clause_id", "rank", "document_rank", "clause_rank", "evidence_no")


def rerank_candidates(spark, sf_dir):
    """Similarity and keyword score of the nearest vectors' documents, best row of each."""
    near = R.vector_search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 50)
    c = near.join(table(spark, sf_dir, "documents"), near["vec_id"] == F.col("doc_id")).crossJoin(F.broadcast(_short_query(spark, sf_dir)))
    c = c.select(F.col("doc_id").alias("clause_id"), "similarity", F.lit(0.0).alias("rrf_score"), F.col("text").alias("search_text"), "q")
    return R.rerank(c, F.col("q"), 20).select("clause_id", "score", "keyword_score", "similarity")


_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{00C0}-\x{024F}]+|[\x{4e00}-\x{9fff}]')"
_POST = f"""
tok AS MATERIALIZED (SELECT doc_id, {_TOK} AS w FROM documents),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM tok) GROUP BY doc_id, term),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
cnt AS MATERIALIZED (SELECT term, count(*) AS c FROM post GROUP BY term),
df AS MATERIALIZED (SELECT term, ln(n - c + 0.5::DOUBLE) - ln(c + 0.5::DOUBLE) AS raw FROM cnt, (SELECT max(n) AS n FROM st)),
idf AS MATERIALIZED (SELECT term, CASE WHEN raw < 0 THEN (SELECT 0.25::DOUBLE * avg(raw) FROM df) ELSE raw END AS idf FROM df)"""
_BM25 = f"""{_POST},
q AS (SELECT term, count(*) AS times FROM (SELECT unnest({_TOK}) AS term FROM benchmark WHERE item_id = 0) GROUP BY term),
sc AS (SELECT doc_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25_score
  FROM post JOIN q USING (term) JOIN idf USING (term), st GROUP BY doc_id),
bm AS (SELECT doc_id, bm25_score, row_number() OVER (ORDER BY bm25_score DESC, doc_id) AS bm25_rank FROM sc ORDER BY bm25_rank LIMIT 50)"""
_VEC = """
sim AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings),
ve AS (SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS vector_rank FROM sim ORDER BY vector_rank LIMIT 50)"""
_KEY = """
q AS (SELECT lower(regexp_replace(text, '\\s+', '', 'g')) AS q FROM benchmark ORDER BY length(text), item_id LIMIT 1),
terms AS (SELECT DISTINCT substr(q, s, n) AS t FROM (SELECT q, n, unnest(range(1, length(q) - n + 2)) AS s FROM q, range(2, 5) r(n))),
ks AS (SELECT doc_id, round_even(least(0.15::DOUBLE, 0.15::DOUBLE * sum(CASE WHEN contains(lower(regexp_replace(text, '\\s+', '', 'g')), t) THEN length(t) ELSE 0 END) / sum(length(t))), 6) AS keyword_score
  FROM documents, terms GROUP BY doc_id)"""

QUERIES = {f.__name__: f for f in (bm25_topk, vector_topk, bm25_topk_each, vector_topk_each, ivf_topk_each, indexed_topk_each, segmented_topk, hybrid_search, bm25_idf, keyword_scores, assertion_boost, evidence_selection, rerank_candidates)}
SQL = {
    "bm25_topk": f"WITH {_BM25} SELECT doc_id, bm25_score, bm25_rank FROM bm",
    "bm25_topk_each": f"""WITH {_POST},
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25_score
  FROM post JOIN q USING (term) JOIN idf USING (term), st GROUP BY query_id, doc_id)
SELECT query_id, doc_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, doc_id) AS bm25_rank FROM sc QUALIFY bm25_rank <= 50""",
    "vector_topk_each": """
WITH sim AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0)
SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS vector_rank FROM sim QUALIFY vector_rank <= 50""",
    "vector_topk": f"WITH {_VEC} SELECT vec_id, similarity, vector_rank FROM ve",
    "hybrid_search": f"""WITH {_BM25}, {_VEC},
u AS (SELECT vec_id AS id, 1.0::DOUBLE / (60 + vector_rank) AS part FROM ve UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + bm25_rank) FROM bm)
SELECT id, round(sum(part), 8) AS rrf_score FROM u GROUP BY id ORDER BY rrf_score DESC, id LIMIT 20""",
    "bm25_idf": f"WITH {_POST} SELECT term, round(idf, 6) AS idf FROM idf",
    "keyword_scores": f"WITH {_KEY} SELECT doc_id, keyword_score FROM ks",
    "assertion_boost": """
SELECT clause_id, round(score + least(0.2::DOUBLE, 0.2::DOUBLE * coalesce(s, 0)), 6) AS score, round(s, 6) AS assertion_score
FROM (SELECT o_orderkey AS clause_id, o_totalprice / 1e6 AS score FROM orders)
LEFT JOIN (SELECT l_orderkey AS clause_id, max(l_discount * 12) AS s FROM lineitem WHERE l_quantity > 45 GROUP BY 1) USING (clause_id)""",
    "evidence_selection": """
WITH c AS (SELECT source AS policy_id, doc_id AS clause_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 30),
f AS (SELECT *, min(rank) OVER (PARTITION BY policy_id) AS first FROM c),
d AS (SELECT *, dense_rank() OVER (ORDER BY first) AS document_rank FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY rank) AS clause_rank FROM d WHERE document_rank <= 3),
e AS (SELECT *, row_number() OVER (ORDER BY rank) AS evidence_no FROM p WHERE clause_rank <= 3)
SELECT policy_id, clause_id, rank, document_rank, clause_rank, evidence_no FROM e WHERE evidence_no <= 8""",
    "rerank_candidates": f"""WITH {_VEC}, {_KEY}
SELECT doc_id AS clause_id, round_even(similarity + keyword_score, 6) AS score, keyword_score, similarity
FROM ve JOIN ks ON vec_id = doc_id ORDER BY score DESC, similarity DESC, keyword_score DESC, clause_id LIMIT 20""",
}
SQL["indexed_topk_each"] = SQL["bm25_topk_each"]
