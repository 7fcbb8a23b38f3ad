"""Trees: the places of the star schema as nodes, and orders as lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrid.operators import hierarchy as H
from docgrid.operators import intervals

from .common import as_duck, made, table


def _nodes(spark, sf_dir):
    """Regions, nations and suppliers as one tree."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"), F.lit(True).alias("structural"), F.col("r_regionkey").cast("long").alias("o"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"), F.lit(True).alias("structural"), F.col("n_nationkey").cast("long").alias("o"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.col("s_name").alias("title"), F.lit(False).alias("structural"), F.col("s_suppkey").cast("long").alias("o"))
    return r.unionByName(n).unionByName(s)


_NODES = """
t AS (SELECT 'r' || r_regionkey AS id, NULL AS p, r_name AS title, true AS structural, r_regionkey::BIGINT AS o FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, true, n_nationkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, false, s_suppkey FROM supplier),
up(descendant, ancestor, distance) AS (SELECT id, p, 1 FROM t WHERE p IS NOT NULL
  UNION ALL SELECT u.descendant, t.p, u.distance + 1 FROM up u JOIN t ON t.id = u.ancestor WHERE t.p IS NOT NULL)"""


def tree_closure(spark, sf_dir):
    return H.closure(_nodes(spark, sf_dir))


def tree_intervals(spark, sf_dir):
    """The pairs of ``tree_closure`` from one row a node."""
    told = intervals.labels(_nodes(spark, sf_dir), order="o")
    return intervals.pairs(told, told)


def tree_context(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    out = H.context(n.filter("NOT structural OR id LIKE 'n%'"), H.closure(n), 5)
    return out.select("id", F.array_join("related", ",").alias("related"), "truncated")


def explicit_matters(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    proof = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return H.explicit_matters(n, H.closure(n), proof, "A").select("id", "title")


def ui_tree(spark, sf_dir):
    """The tree and five rows with a cycle and a missing parent."""
    more = spark.createDataFrame([("x1", "x2", 1), ("x2", "x3", 2), ("x3", "x1", 3), ("x4", "x1", 4), ("x5", "gone", 5)], "id string, parent_id string, o long")
    return H.ui_tree(_nodes(spark, sf_dir).select("id", "parent_id", "o").unionByName(more), "id", "parent_id", "o")


def workflow_order(spark, sf_dir):
    """Turns of conversations as steps; a letter stands for the words that name an order."""
    return H.workflow_view(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", ("[Tt]hen", "é"))


#: Orders of a customer as the lines of a document, in nine kinds.
LINES = """SELECT c AS policy_id, CAST(1 + floor(n / 4) AS INTEGER) AS page, n AS ordinal, 0 AS line_no, CASE n % 9 WHEN 0 THEN '第' || (1 + n) || '章 ' || t WHEN 1 THEN '第 ' || n || ' 条 目的' || t || '。 第' || (n + 50) || '条 范围'
  WHEN 2 THEN '（一）' || t WHEN 3 THEN '1. ' || k WHEN 4 THEN '续行' || k WHEN 5 THEN '(二) ' || t WHEN 6 THEN '（' || n || '） 细目' WHEN 7 THEN ' ' ELSE '第' || n || '条' || k END AS line
  FROM (SELECT CAST(o_custkey AS INTEGER) AS c, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS n, o_orderpriority AS t, o_orderkey AS k FROM {orders}) AS o"""


def clause_tree(spark, sf_dir):
    out = H.build_clauses(made(spark, sf_dir, LINES))
    return out.select("policy_id", "sequence_no", F.col("parent_no").cast("long").alias("parent_no"), "level", "article_no", "item_no", F.array_join("chapter_path", "/").alias("path"), "raw_text", "page_start", "page_end")


def parse_quality(spark, sf_dir):
    """Documents as blocks, their first half as clauses."""
    d = table(spark, sf_dir, "documents")
    b = d.select(F.col("source").alias("policy_id"), F.lit("text").alias("type"), F.col("text").alias("content"), F.lit("").alias("table_html"), F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(*[F.lit(1.0)] * 4)).alias("bbox"))
    c = d.select(F.col("source").alias("policy_id"), F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("raw_text"))
    return H.parse_quality(b, c)


QUERIES = {f.__name__: f for f in (tree_closure, tree_intervals, tree_context, explicit_matters, ui_tree, workflow_order, clause_tree, parse_quality)}
SQL = {
    "tree_closure": f"WITH RECURSIVE {_NODES} SELECT ancestor, descendant, min(distance) AS distance FROM up GROUP BY 1, 2",
    "tree_context": f"""WITH RECURSIVE {_NODES}, h AS (SELECT id FROM t WHERE NOT structural OR id LIKE 'n%'),
e AS (SELECT descendant AS id, ancestor AS other FROM up UNION SELECT ancestor, descendant FROM up),
g AS (SELECT id, list_sort(list(DISTINCT other)) AS a FROM h JOIN e USING (id) GROUP BY id)
SELECT id, array_to_string(coalesce(a, [])[1:5], ',') AS related, coalesce(len(a), 0) > 5 AS truncated FROM h LEFT JOIN g USING (id)""",
    "explicit_matters": f"""WITH RECURSIVE {_NODES}, proof AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal > 0),
c AS (SELECT id, title FROM t WHERE structural AND title LIKE '%A%' AND id IN (SELECT ancestor FROM up JOIN proof ON descendant = proof.id))
SELECT id, title FROM c WHERE id NOT IN (SELECT ancestor FROM up JOIN c ON descendant = c.id)""",
    "ui_tree": f"""WITH RECURSIVE {_NODES},
w AS (SELECT t.id, o, lpad(CAST(o AS VARCHAR), 8, '0') AS path, id AS root, 0 AS level FROM t WHERE p IS NULL
  UNION ALL SELECT t.id, t.o, w.path || '/' || lpad(CAST(t.o AS VARCHAR), 8, '0'), w.root, w.level + 1 FROM w JOIN t ON t.p = w.id)
SELECT id, root, level, path FROM w UNION ALL SELECT * FROM (VALUES ('x1', 'x1', 0, '00000001'), ('x2', 'x2', 0, '00000002'), ('x3', 'x3', 0, '00000003'), ('x4', 'x1', 1, '00000001/00000004'), ('x5', 'x5', 0, '00000005'))""",
    "workflow_order": """WITH n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_matches(text, '[Tt]hen|é') AS said FROM conversations)
SELECT conv_id, count(*) AS n_steps, count(*) >= 2 AND coalesce(bool_and(said) FILTER (n > 1), false) AS order_confirmed FROM n GROUP BY 1""",
    "clause_tree": f"""WITH l AS ({as_duck(LINES)}),
p AS (SELECT policy_id, page, ordinal, 0 AS part, ordinal % 9 AS kind, CASE WHEN ordinal % 9 = 1 THEN split_part(line, '。 第', 1) || '。' ELSE line END AS line FROM l WHERE trim(line) <> ''
  UNION ALL SELECT policy_id, page, ordinal, 1, 9, '第' || split_part(line, '。 第', 2) FROM l WHERE ordinal % 9 = 1),
m AS (SELECT *, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 8 THEN 3 WHEN 9 THEN 3 WHEN 2 THEN 6 WHEN 5 THEN 6 WHEN 3 THEN 7 WHEN 6 THEN 8 END AS slot,
  CASE kind WHEN 0 THEN regexp_replace(line, '^第([0-9]+)章 *', '第\\1章 ') WHEN 1 THEN regexp_replace(line, '^第 ([0-9]+) 条 *', '第\\1条 ') WHEN 8 THEN regexp_replace(line, '^第([0-9]+)条', '第\\1条 ')
  WHEN 2 THEN '（一） ' || substr(line, 4) WHEN 5 THEN '（二） ' || substr(line, 5) WHEN 6 THEN regexp_replace(line, '^（([0-9]+)） *', '（\\1） ') ELSE line END AS said FROM p),
s AS (SELECT *, CAST(count(slot) OVER (PARTITION BY policy_id ORDER BY ordinal, part) AS INTEGER) AS sequence_no FROM m),
n AS (SELECT policy_id, sequence_no, max(slot) AS slot, string_agg(said, chr(10) ORDER BY ordinal, part) AS raw_text, first(page ORDER BY ordinal, part) AS page_start, max(page) AS page_end FROM s GROUP BY 1, 2),
u AS (SELECT n.*, (SELECT max(sequence_no) FROM n p WHERE p.policy_id = n.policy_id AND p.sequence_no < n.sequence_no AND p.slot < n.slot) AS parent_no,
  (SELECT max(sequence_no) FROM n p WHERE p.policy_id = n.policy_id AND p.sequence_no <= n.sequence_no AND p.slot = 3) AS article_at, (SELECT max(sequence_no) FROM n p WHERE p.policy_id = n.policy_id AND p.sequence_no <= n.sequence_no AND p.slot = 1) AS chapter_at FROM n)
SELECT u.policy_id, u.sequence_no, CAST(u.parent_no AS BIGINT) AS parent_no, CASE u.slot WHEN 1 THEN 'chapter' WHEN 3 THEN 'article' ELSE 'item' END AS level,
  CASE WHEN u.slot > 1 AND article_at > coalesce(chapter_at, 0) THEN regexp_extract(a.raw_text, '^第([0-9]+)条', 1) ELSE '' END AS article_no, CASE WHEN u.slot > 5 THEN regexp_extract(u.raw_text, '^（[^）]*）|^[0-9]+[.]') ELSE '' END AS item_no,
  coalesce(regexp_extract(c.raw_text, '^第[0-9]+章'), '') AS path, u.raw_text, u.page_start, u.page_end
FROM u LEFT JOIN n a ON a.policy_id = u.policy_id AND a.sequence_no = article_at LEFT JOIN n c ON c.policy_id = u.policy_id AND c.sequence_no = chapter_at""",
    "parse_quality": """SELECT source AS policy_id, round_even(0.45::DOUBLE * least(1.0::DOUBLE, sum(floor(length(text) / 2)) / sum(length(text))) + 0.25::DOUBLE * avg(CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) + 0.30::DOUBLE, 4) AS quality
FROM documents WHERE trim(text) <> '' GROUP BY 1""",
}
SQL["tree_intervals"] = SQL["tree_closure"]
