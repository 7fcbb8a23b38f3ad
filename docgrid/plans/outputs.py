"""A model's entities and relations: orders as clauses, with two entities and two relations said of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrid.operators import outputs as O

from .common import as_duck, made

CLAUSES = "SELECT o_orderkey AS clause_id, '申请人 提交' || o_orderpriority || '，由' || o_custkey || '处审核。' AS raw_text FROM {orders}"
ENTITIES = """SELECT o_orderkey AS clause_id, p AS position, CASE o_orderkey % 5 WHEN 0 THEN ' 材料' WHEN 1 THEN 'bogus' ELSE '部门' END AS type, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN p = 0 THEN o_orderpriority ELSE o_custkey || '处' END AS name,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_custkey || '处' END AS raw_text, CASE WHEN o_orderkey % 7 = 0 THEN 'made up' ELSE '' END AS evidence, CASE o_orderkey % 6 WHEN 0 THEN '1.7' WHEN 1 THEN 'sure' WHEN 2 THEN '-1' WHEN 3 THEN '0.9' ELSE '0.' || (5 + p * 2) END AS confidence
  FROM {orders} CROSS JOIN (VALUES (0), (1)) AS v(p)"""
RELATIONS = """SELECT o_orderkey AS clause_id, p AS position, CASE o_orderkey % 4 WHEN 0 THEN '需要材料' WHEN 1 THEN 'odd' WHEN 2 THEN 'handled_by' ELSE '引用' END AS type, p AS subject, o_orderkey % 3 AS object, CASE WHEN o_orderkey % 8 = 3 THEN o_orderpriority ELSE '' END AS target_text,
  CASE WHEN o_orderkey % 5 = 0 THEN 'elsewhere' WHEN p = 0 THEN '由' || o_custkey || ' 处审核' ELSE '' END AS evidence, CASE WHEN o_orderkey % 9 = 0 THEN '0.5' ELSE '0.95' END AS confidence FROM {orders} CROSS JOIN (VALUES (0), (1)) AS v(p)"""


def _built(spark, sf_dir):
    return O.build(made(spark, sf_dir, ENTITIES), made(spark, sf_dir, RELATIONS), made(spark, sf_dir, CLAUSES))


def model_entities(spark, sf_dir):
    return _built(spark, sf_dir)["entities"]


def model_relations(spark, sf_dir):
    return _built(spark, sf_dir)["relations"]


def model_reviews(spark, sf_dir):
    return _built(spark, sf_dir)["reviews"].groupBy("issue_type").agg(F.count("*").alias("n"), F.count_distinct("candidate_id").alias("candidates"))


QUERIES = {f.__name__: f for f in (model_entities, model_relations, model_reviews)}
_HASH = "substr(sha256(concat_ws(chr(31), {})), 1, 24)"
_PROVED = r"{0} <> '' AND contains(regexp_replace(source, '\s+', '', 'g'), regexp_replace({0}, '\s+', '', 'g'))"
_BUILT = f"""c AS (SELECT clause_id, raw_text AS source FROM ({as_duck(CLAUSES)})),
e AS (SELECT clause_id, position, CASE trim(type) WHEN '材料' THEN 'material' WHEN '部门' THEN 'department' END AS kind, coalesce(nullif(name, ''), raw_text) AS name, coalesce(nullif(evidence, ''), raw_text) AS evidence,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(confidence AS DOUBLE), 0.0::DOUBLE))) AS confidence FROM ({as_duck(ENTITIES)})),
i AS (SELECT *, 'entity_' || {_HASH.format("clause_id, kind, name")} AS entity_id FROM e WHERE kind IS NOT NULL),
x AS (SELECT r.clause_id, r.position, CASE type WHEN '需要材料' THEN 'requires_material' WHEN 'handled_by' THEN 'handled_by' WHEN '引用' THEN 'cites' END AS kind, s.entity_id AS subject_id, o.entity_id AS object_id, target_text,
  coalesce(nullif(evidence0, ''), target_text) AS evidence, CAST(confidence AS DOUBLE) AS confidence, source
  FROM (SELECT * EXCLUDE (evidence), evidence AS evidence0 FROM ({as_duck(RELATIONS)})) r JOIN c USING (clause_id) LEFT JOIN (SELECT clause_id, position, entity_id FROM i) s ON s.clause_id = r.clause_id AND s.position = r.subject LEFT JOIN (SELECT clause_id, position, entity_id FROM i) o ON o.clause_id = r.clause_id AND o.position = r.object),
m AS (SELECT *, {_PROVED.format("evidence")} AND CASE WHEN kind = 'cites' THEN target_text <> '' ELSE subject_id IS NOT NULL AND object_id IS NOT NULL END AS valid FROM x),
u AS (SELECT *, 'relation_' || {_HASH.format("clause_id, kind, target_text, evidence")} AS relation_id FROM m WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY clause_id, kind, target_text, evidence ORDER BY position) = 1)"""
SQL = {
    "model_entities": f"""WITH {_BUILT} SELECT entity_id, clause_id, kind AS entity_type, name, evidence, confidence, 'pending' AS review_status FROM i QUALIFY row_number() OVER (PARTITION BY clause_id, kind, name ORDER BY confidence DESC, position) = 1""",
    "model_relations": f"""WITH {_BUILT} SELECT relation_id, clause_id, kind AS relation_type, subject_id, object_id, target_text, evidence, confidence, 'pending' AS review_status FROM u""",
    "model_reviews": f"""WITH {_BUILT}, a AS (SELECT 'invalid_entity_type' AS issue_type, NULL AS candidate_id FROM e WHERE kind IS NULL UNION ALL SELECT 'invalid_relation_type', NULL FROM m WHERE kind IS NULL UNION ALL SELECT 'low_confidence_relation', relation_id FROM u WHERE NOT valid OR confidence < 0.85)
SELECT issue_type, count(*) AS n, count(DISTINCT candidate_id) AS candidates FROM a GROUP BY 1""",
}
