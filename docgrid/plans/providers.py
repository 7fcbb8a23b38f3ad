"""Index texts, cached scores and hashed vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrid.operators import providers as P
from docgrid.operators import retrieval as R

from .common import table


def index_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", P.index_text(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_brand")), F.col("p_type")).alias("text"))


def assertion_texts(spark, sf_dir):
    """What is searched of parts as assertions, some of their parties blank and some without qualifiers."""
    p = table(spark, sf_dir, "part")
    said = F.when(F.col("p_size") % 3 > 0, F.array(F.col("p_brand"), F.lit(" ")))
    return p.select("p_partkey", P.assertion_text(F.col("p_name"), F.lit("uses"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.lit(""), said).alias("text"))


def cached_scores(spark, sf_dir):
    """Benchmark items as candidates, earlier scores of every third one in the cache, old ones of every fifth."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("search_text"))
    cache = b.filter("item_id % 3 = 0").select(P.cache_key(F.lit("q"), F.col("search_text"), "v1").alias("cache_key"), (F.col("item_id") / 1000).alias("score"), F.when(F.col("item_id") % 5 == 0, "2024-01-01 00:00:00").otherwise("2024-01-01 11:55:00").cast("timestamp").alias("cached_at"))
    return P.cached_scores(b, cache, "q", F.lit("2024-01-01 12:00:00").cast("timestamp")).select("item_id", "cached_score")


def score_cache(spark, sf_dir):
    """The cache after all events as uses: purchases store a user's score, others read it, and errors are of an older
    generation."""
    e = table(spark, sf_dir, "events")
    uses = e.select(F.concat(F.lit("u"), "user_id").alias("cache_key"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("score"), F.col("ts").cast("timestamp").alias("used_at"), F.when(F.col("event_type") == "error", 1).otherwise(2).alias("generation"))
    none = uses.limit(0).select("cache_key", F.col("score").cast("double").alias("score"), F.col("used_at").alias("cached_at"), F.col("used_at").alias("last_used"), "generation")
    last = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp")
    out = P.merged_cache(none, uses, 2, last, 40 * 86_400)
    return out.select("cache_key", "score", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss").alias("cached_at"), F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


def hashed_search(spark, sf_dir):
    """Documents nearest to the first benchmark item by hashed vectors."""
    docs = P.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text")
    query = P.hashed_vectors(table(spark, sf_dir, "benchmark").filter("item_id = 0"), "item_id", "text").select(F.col("embedding").alias("query_vector"))
    return R.vector_search(docs, query, 20, "doc_id")


QUERIES = {f.__name__: f for f in (index_texts, assertion_texts, cached_scores, score_cache, hashed_search)}
SQL = {
    "index_texts": "SELECT p_partkey, concat_ws(chr(10), p_name, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_brand END, p_type) AS text FROM part",
    "assertion_texts": "SELECT p_partkey, concat_ws(' ', p_name, 'uses', CASE WHEN p_size % 2 = 0 THEN p_type END, CASE WHEN p_size % 3 > 0 THEN p_brand END) AS text FROM part",
    "score_cache": """WITH e AS (SELECT 'u' || user_id AS cache_key, CASE WHEN event_type = 'purchase' THEN value END AS score, CAST(ts AS TIMESTAMP) AS t FROM events WHERE event_type <> 'error'),
g AS (SELECT cache_key, max({'t': t, 'score': score}) FILTER (WHERE score IS NOT NULL) AS s, max(t) AS last_used FROM e GROUP BY cache_key)
SELECT cache_key, s.score AS score, strftime(s.t, '%Y-%m-%d %H:%M:%S') AS cached_at, strftime(last_used, '%Y-%m-%d %H:%M:%S') AS last_used FROM g
WHERE s IS NOT NULL AND floor(epoch((SELECT max(CAST(ts AS TIMESTAMP)) FROM events))) - floor(epoch(s.t)) <= 40 * 86400 ORDER BY g.last_used DESC, cache_key LIMIT 256""",
    "cached_scores": "WITH c AS (SELECT text, max(item_id) / 1000.0::DOUBLE AS s FROM benchmark WHERE item_id % 3 = 0 AND item_id % 5 <> 0 GROUP BY text) SELECT item_id, s AS cached_score FROM benchmark LEFT JOIN c USING (text)",
}
