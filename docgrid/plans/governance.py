"""Validity, families and targets, on orders as versions of documents and on literal Chinese rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docgrid.functions import text as T
from docgrid.operators import governance as G

from .common import as_duck, made, table

AS_OF, TODAY = "1998-06-01", "2000-01-01"


def _versions(spark, sf_dir):
    """Orders of a customer as versions: each ends when the next but one begins."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.col("o_custkey").alias("family_id"), F.col("o_orderkey").alias("policy_id"),
        F.when(F.col("o_orderkey") % 17 != 0, F.to_date("o_orderdate")).alias("effective_date"), F.to_date(F.lead("o_orderdate", 2).over(w)).alias("expiry_date"),
        F.when(F.col("o_orderstatus") == "F", "invalid").when(F.col("o_orderstatus") == "O", "current").otherwise("unknown").alias("validity_status"),
        (F.col("o_totalprice") / 1e6).alias("score"),
    )


_VERSIONS = """
v AS (SELECT o_custkey AS family_id, o_orderkey AS policy_id, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS effective_date,
  CAST(lead(o_orderdate, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS expiry_date,
  CASE o_orderstatus WHEN 'F' THEN 'invalid' WHEN 'O' THEN 'current' ELSE 'unknown' END AS validity_status, o_totalprice / 1e6 AS score FROM orders),
s AS (SELECT *, CASE WHEN effective_date IS NOT NULL AND DATE '1998-06-01' < effective_date THEN 'inapplicable'
  WHEN expiry_date IS NOT NULL AND DATE '1998-06-01' >= expiry_date THEN 'inapplicable'
  WHEN validity_status = 'invalid' AND expiry_date IS NULL THEN CASE WHEN DATE '1998-06-01' >= DATE '2000-01-01' THEN 'inapplicable' ELSE 'unknown' END
  WHEN validity_status = 'unknown' THEN 'unknown' WHEN validity_status IN ('current', 'invalid') THEN 'applicable'
  WHEN effective_date IS NOT NULL THEN 'applicable' ELSE 'unknown' END AS temporal_status FROM v)"""


def _status(spark, sf_dir):
    v = _versions(spark, sf_dir)
    return v.withColumn("temporal_status", G.temporal_status(F.lit(AS_OF).cast("date"), F.lit(TODAY).cast("date"), F.col("effective_date"), F.col("expiry_date"), F.col("validity_status")))


def temporal_status(spark, sf_dir):
    return _status(spark, sf_dir).select("policy_id", "temporal_status")


def temporal_rank(spark, sf_dir):
    v = _versions(spark, sf_dir)
    c = v.select(F.col("policy_id").alias("clause_id"), "policy_id", F.round("score", 3).alias("score"))
    return G.temporal_rank(c, v, F.lit(AS_OF).cast("date"), F.lit(TODAY).cast("date"), 50).select("clause_id", "score", "temporal_status")


def family_warnings(spark, sf_dir):
    return G.family_warnings(_status(spark, sf_dir))


def family_overlaps(spark, sf_dir):
    return G.family_overlaps(_versions(spark, sf_dir), "family_id", "policy_id", "effective_date", "expiry_date")


def governance_counts(spark, sf_dir):
    s = _status(spark, sf_dir)
    return s.groupBy("validity_status").agg(F.count("*").alias("n"), F.count_if(F.col("temporal_status") == "applicable").alias("applicable"), F.count_if(F.col("effective_date").isNull()).alias("undated"))


def effective_date_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey", F.to_date("o_orderdate").alias("d"))
    return G.distinct_date_status(o, "o_custkey", "d").withColumn("effective_date", F.col("effective_date").cast("string"))


def unique_targets(spark, sf_dir):
    """Part types as titles: only those of exactly one other part resolve."""
    p = table(spark, sf_dir, "part")
    docs = p.select(F.col("p_partkey").cast("string").alias("policy_id"), F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")).alias("title"), F.lit("").alias("doc_number"), F.lit(None).cast("date").alias("issue_date"))
    rel = p.select(F.col("p_partkey").cast("string").alias("relation_id"), F.lit("1").alias("source_policy_id"), F.concat_ws("", "p_brand", "p_type", F.col("p_size").cast("string")).alias("target_title"), F.lit("").alias("target_doc_number"), F.lit(None).cast("int").alias("target_year"))
    return G.resolve_targets(rel, docs)


def same_title_links(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("title"))
    return G.same_title_pairs(d, "title", "doc_id").select("left_id", "right_id")


def backfill_validity(spark, sf_dir):
    """Orders with a pending ('P') follow-up of the same customer."""
    o = table(spark, sf_dir, "orders")
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("policy_id"), F.when(F.col("c_acctbal") < 0, "invalid").alias("validity_status"))
    rel = o.select(F.col("o_custkey").alias("target_policy_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("review_status"))
    return G.backfill_validity(docs, rel)


#: Parts as numbers, days and titles in the forms that there are, orders as clauses that say norms and days.
NUMBERS = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN '校发（2023）00' || p_size || '号' WHEN 1 THEN '校发〔' || (1990 + p_size) || '〕' || p_partkey || '号' WHEN 2 THEN '校字[20230' || p_size || '号' WHEN 3 THEN ' 教 研﹝2019﹞ 0' || p_size || ' 号'
  WHEN 4 THEN 'X-2020-' || p_size WHEN 5 THEN '校发【2021】000号' WHEN 6 THEN '' ELSE '内部(2020)' || p_size || '号文' END AS raw FROM {part}"""
DATES = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '2024年' || (p_size % 15) || '月5日' WHEN 1 THEN '2024/' || p_size || '/01' WHEN 2 THEN '2024-02-' || p_size || ' 印发' WHEN 3 THEN '20' || p_size || '-2-29' WHEN 4 THEN p_name ELSE '2024.7.' || p_size END AS raw FROM {part}"""
TITLES = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '关于印发《' || p_type || '管理办法（修订）》的通知' WHEN 1 THEN p_name || '办法试行' WHEN 2 THEN '《' || p_type || ' 规定》' WHEN 3 THEN p_brand || '规定（暂行）' WHEN 4 THEN p_brand || '办法修订版' ELSE '' END AS raw FROM {part}"""
NORMS = """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN '各单位应当提前申请' || o_custkey || '，不得拆分采购。' WHEN 1 THEN '负责人' || o_custkey || '可以委托他人办理。' WHEN 2 THEN '须由' || o_orderpriority || '批准' WHEN 3 THEN '可向财务处申请'
  WHEN 4 THEN '本办法由' || o_orderstatus || '解释。' WHEN 5 THEN ' ' ELSE '严禁违规，必须整改，有权拒绝' END AS raw FROM {orders}"""
EFFECTIVE = """SELECT o_custkey AS policy_id, CASE o_orderkey % 9 WHEN 0 THEN '本办法自2024年1月' || (1 + o_custkey % 3) || '日起施行。' WHEN 1 THEN '自 2024 年 1 月 ' || (1 + o_orderkey % 31) || ' 日起 执行' WHEN 2 THEN '本规定自发布之日起施行' WHEN 3 THEN '自印发之日起执行' WHEN 4 THEN '自2021年2月30日起施行' ELSE o_orderpriority END AS text,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS issued FROM {orders} WHERE o_orderstatus = 'P'"""


def document_numbers(spark, sf_dir):
    d = made(spark, sf_dir, NUMBERS)
    return d.select("id", T.normalize_document_number(F.col("raw")).alias("number"), T.display_document_number(F.col("raw")).alias("shown"), T.publication_year(F.col("raw"), F.lit(None).cast("date")).alias("year"))


def dates_parsed(spark, sf_dir):
    d = made(spark, sf_dir, DATES)
    return d.select("id", T.parse_date(F.col("raw")).cast("string").alias("day"))


def family_titles(spark, sf_dir):
    d = made(spark, sf_dir, TITLES)
    return d.select("id", T.normalize_family_title(F.col("raw")).alias("title"))


def norm_labels(spark, sf_dir):
    d = made(spark, sf_dir, NORMS)
    return d.select("id", F.array_join(T.norm_labels(F.col("raw")), ",").alias("labels"), (F.size(T.norm_labels(F.col("raw"))) == 0).alias("needs_model"))


def norm_evidence(spark, sf_dir):
    """The words by which each norm of a clause is known."""
    e = made(spark, sf_dir, NORMS).select("id", T.norm_evidence(F.col("raw")).alias("e"))
    return e.select("id", *[F.try_element_at("e", F.lit(k)).alias(k) for k in ("obligation", "permission", "prohibition")])


def effective_date_texts(spark, sf_dir):
    d = made(spark, sf_dir, EFFECTIVE)
    return G.effective_date_status(d, "policy_id", "text", "issued").select("policy_id", F.col("effective_date").cast("string").alias("effective_date"), "status")


_SP = r"[\s\x{3000}]+"
_NUM = rf"regexp_replace(regexp_replace(translate(regexp_replace(raw, '{_SP}', '', 'g'), '（〔﹝［【(）〕﹞］】)', '[[[[[[]]]]]]'), '^([\x{{4e00}}-\x{{9fff}}]+字\[)((?:19|20)[0-9]{{2}})([0-9]{{1,6}}号)$', '\1\2]\3'), '(\[[0-9]{{4}}\])0+([0-9]+号)$', '\1\2')"
_DATE = r"([0-9]{4})\s*[-/.年]\s*([0-9]{1,2})\s*[-/.月]\s*([0-9]{1,2})"

QUERIES = {
    f.__name__: f
    for f in (temporal_status, temporal_rank, family_warnings, family_overlaps, governance_counts, effective_date_sets, unique_targets, same_title_links, backfill_validity, document_numbers, dates_parsed, family_titles, norm_labels, norm_evidence, effective_date_texts)
}
SQL = {
    "temporal_status": f"WITH {_VERSIONS} SELECT policy_id, temporal_status FROM s",
    "temporal_rank": f"""WITH {_VERSIONS} SELECT policy_id AS clause_id, round(score, 3) AS score, temporal_status FROM s WHERE temporal_status <> 'inapplicable'
ORDER BY round(score, 3) DESC, CASE WHEN temporal_status = 'applicable' THEN 0 ELSE 1 END, policy_id LIMIT 50""",
    "family_warnings": f"""WITH {_VERSIONS} SELECT family_id, string_agg(CAST(policy_id AS VARCHAR), ',' ORDER BY policy_id) AS policy_ids, CAST(count(*) AS INTEGER) AS n_versions
FROM s WHERE temporal_status = 'applicable' GROUP BY family_id HAVING count(*) > 1""",
    "family_overlaps": f"""WITH {_VERSIONS} SELECT a.family_id, a.policy_id AS left_id, b.policy_id AS right_id FROM v a JOIN v b ON a.family_id = b.family_id AND a.policy_id < b.policy_id
AND a.effective_date IS NOT NULL AND b.effective_date IS NOT NULL AND (b.expiry_date IS NULL OR a.effective_date < b.expiry_date) AND (a.expiry_date IS NULL OR b.effective_date < a.expiry_date)""",
    "governance_counts": f"""WITH {_VERSIONS} SELECT validity_status, count(*) AS n, count(*) FILTER (temporal_status = 'applicable') AS applicable, count(*) FILTER (effective_date IS NULL) AS undated FROM s GROUP BY 1""",
    "effective_date_sets": """SELECT o_custkey, CASE WHEN n = 1 THEN CAST(d AS VARCHAR) END AS effective_date, CASE WHEN n > 1 THEN 'conflict' WHEN n = 1 THEN 'identified' ELSE 'unknown' END AS status
FROM (SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS n, min(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)""",
    "unique_targets": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, regexp_replace(concat_ws('', p_brand, p_type, CAST(p_size AS VARCHAR)), '\\s+', '', 'g') AS t FROM part),
m AS (SELECT a.id, count(b.id) AS n, min(b.id) AS b FROM p a LEFT JOIN p b ON a.t = b.t AND b.id <> '1' GROUP BY a.id)
SELECT id AS relation_id, CASE WHEN n = 1 THEN b END AS target_policy_id FROM m""",
    "same_title_links": "SELECT left_id, right_id FROM (SELECT min(doc_id) OVER (PARTITION BY text) AS left_id, doc_id AS right_id FROM documents) WHERE left_id <> right_id",
    "backfill_validity": """SELECT c_custkey AS policy_id, CASE WHEN c_acctbal < 0 THEN 'invalid' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'unknown' ELSE 'current' END AS validity_status FROM customer""",
    "document_numbers": f"""SELECT id, {_NUM} AS number, translate({_NUM}, '[]', '〔〕') AS shown,
TRY_CAST(nullif(regexp_extract({_NUM}, '\\[((?:19|20)[0-9]{{2}})\\]', 1), '') AS INTEGER) AS year FROM ({as_duck(NUMBERS)})""",
    "dates_parsed": rf"""SELECT id, CAST(TRY_CAST(nullif(regexp_extract(raw, '{_DATE}', 1) || '-' || lpad(regexp_extract(raw, '{_DATE}', 2), 2, '0') || '-' || lpad(regexp_extract(raw, '{_DATE}', 3), 2, '0'), '-00-00') AS DATE) AS VARCHAR) AS day
FROM ({as_duck(DATES)})""",
    "family_titles": rf"""SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '{_SP}', '', 'g'), '^关于印发《?(.+?)》?的通知$', '\1'), '[（(](?:修订|试行|暂行)[）)]$', ''), '(?:修订版|试行|暂行)$', ''), '^[《》]+|[《》]+$', '', 'g') AS title
FROM ({as_duck(TITLES)})""",
    "norm_labels": f"""SELECT id, CASE WHEN trim(raw) = '' THEN 'other' ELSE concat_ws(',', o, p, n) END AS labels, trim(raw) <> '' AND o IS NULL AND p IS NULL AND n IS NULL AS needs_model FROM (SELECT *,
CASE WHEN regexp_matches(raw, '应当|必须|须[予由向将对按依在于为]|有义务') THEN 'obligation' END AS o,
CASE WHEN regexp_matches(raw, '可以|可[向由在按依申请办理享有]|有权') THEN 'permission' END AS p,
CASE WHEN regexp_matches(raw, '不得|严禁|禁止|不允许') THEN 'prohibition' END AS n FROM ({as_duck(NORMS)}))""",
    "norm_evidence": f"""SELECT id, CASE id % 7 WHEN 0 THEN '应当' WHEN 2 THEN '须' WHEN 6 THEN '必须' END AS obligation, CASE id % 7 WHEN 1 THEN '可以' WHEN 3 THEN '可' WHEN 6 THEN '有权' END AS permission,
CASE id % 7 WHEN 0 THEN '不得' WHEN 6 THEN '严禁' END AS prohibition FROM ({as_duck(NORMS)})""",
    "effective_date_texts": f"""WITH r AS (SELECT policy_id, TRY_CAST(nullif(regexp_replace(regexp_extract(text, '自\\s*(\\d{{4}}\\s*年\\s*\\d{{1,2}}\\s*月\\s*\\d{{1,2}})\\s*日\\s*起\\s*(?:施行|执行|生效)', 1), '\\s*[年月]\\s*', '-', 'g'), '') AS DATE) AS d,
  regexp_matches(text, '自\\s*(?:发布|印发)\\s*之日\\s*起\\s*(?:施行|执行|生效)') AS rel, CAST(issued AS DATE) AS issued FROM ({as_duck(EFFECTIVE)})),
g AS (SELECT policy_id, count(DISTINCT d) AS n, min(d) AS d, bool_or(rel) AS rel FROM (SELECT policy_id, d, rel FROM r UNION ALL SELECT policy_id, issued, rel FROM r WHERE rel) GROUP BY 1)
SELECT policy_id, CASE WHEN n = 1 THEN CAST(d AS VARCHAR) END AS effective_date, CASE WHEN n > 1 THEN 'conflict' WHEN n = 1 THEN 'identified' WHEN rel THEN 'needs_review' ELSE 'unknown' END AS status FROM g""",
}
