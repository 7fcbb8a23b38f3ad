"""Governed tables: orders, lines and conversations stand for documents, relations and clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrid.operators import metadata as M
from docgrid.operators import policies as P
from docgrid.operators import review as R

from .common import as_duck, made, table

LEVELS = ("preamble", "chapter", "article", "paragraph", "item")


def _clauses(spark, sf_dir):
    """Turns of conversations as clauses of five levels."""
    level = F.get(F.array(*[F.lit(x) for x in LEVELS]), (F.col("turn") % 5).cast("int"))
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("policy_id"), F.concat("conv_id", F.lit("-"), "turn").alias("clause_id"), level.alias("level"), F.when(F.length("text") % 7 != 0, F.col("text")).otherwise(" ").alias("raw_text"),
        F.when(F.length("text") % 3 == 0, "x").otherwise(F.col("text")).alias("search_text"), F.col("turn").alias("sequence_no"), F.when(F.col("turn") % 2 == 0, "v1").otherwise("v2").alias("structure_version"), (F.col("turn") != 3).alias("is_active"),
    )


_C = f"""c AS (SELECT CAST(conv_id AS VARCHAR) AS policy_id, conv_id || '-' || turn AS clause_id, [{', '.join(f"'{x}'" for x in LEVELS)}][turn % 5 + 1] AS level,
  CASE WHEN length(text) % 7 <> 0 THEN text ELSE ' ' END AS raw_text, CASE WHEN length(text) % 3 = 0 THEN 'x' ELSE text END AS search_text, turn AS sequence_no,
  CASE WHEN turn % 2 = 0 THEN 'v1' ELSE 'v2' END AS structure_version, turn <> 3 AS is_active FROM conversations)"""


def _relations(spark, sf_dir):
    """Orders as relations to the customer of the next number."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("relation_id"), F.col("o_custkey").alias("source_policy_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") + 1).alias("target_policy_id"), F.to_date("o_orderdate").alias("effective_date"),
        F.when(F.col("o_orderstatus") == "O", "approved").when(F.col("o_orderstatus") == "P", "pending").otherwise("rejected").alias("review_status"),
    )


_R = """r AS (SELECT o_orderkey AS relation_id, o_custkey AS source_policy_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey + 1 END AS target_policy_id, CAST(o_orderdate AS DATE) AS effective_date,
  CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'P' THEN 'pending' ELSE 'rejected' END AS review_status FROM orders)"""


def clause_selections(spark, sf_dir):
    c = _clauses(spark, sf_dir)
    return c.select("clause_id", P.searchable(F.col("level"), F.col("raw_text")).alias("searchable"), P.substantive(F.col("level"), F.col("raw_text"), F.col("search_text")).alias("substantive"))


def extraction_selection(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("policy_id"), F.concat(F.lit("f"), F.col("conv_id") % 7).alias("file_name")).distinct()
    return P.extraction_selection(_clauses(spark, sf_dir), d).select("file_name", "policy_id", "clause_id")


def eligible_labels(spark, sf_dir):
    c = _clauses(spark, sf_dir)
    labels = c.select("clause_id", F.when(F.col("sequence_no") % 2 == 0, "process").otherwise("pending").alias("decision"), F.lit("approved").alias("review_status"), F.when(F.length("raw_text") % 2 == 0, F.array(F.lit("travel"))).otherwise(F.array(F.lit("travel"), F.lit("old"))).alias("domains"), F.substring_index("search_text", ".", 1).alias("evidence_text"))
    return P.eligible_labels(labels, c.select("clause_id", "raw_text", "sequence_no"), ["travel"]).select("clause_id")


def active_clauses(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("policy_id"), F.when(F.col("conv_id") % 2 == 0, "v1").otherwise("v2").alias("structure_version")).distinct()
    return P.active_clauses(_clauses(spark, sf_dir), d).select("policy_id", "clause_id")


def batch_documents(spark, sf_dir):
    items = table(spark, sf_dir, "events").filter("event_type <> 'error'").select(F.when(F.col("event_id") % 5 == 0, F.col("user_id") + 1).alias("reuse_file_id"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("file_id"))
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.when(F.col("c_acctbal") > 0, "succeeded").otherwise("failed").alias("structure_status"))
    return P.batch_documents(items, d).select("file_id")


def upsert_documents(spark, sf_dir):
    """Orders of even keys as stored documents, of keys divisible by three as new ones."""
    o = table(spark, sf_dir, "orders")
    cols = lambda shift, source: [F.col("o_orderkey").alias("policy_id"), F.col("o_orderkey").alias("file_id"), F.when(F.col("o_custkey") % 3 > 0, F.date_add(F.to_date("o_orderdate"), shift)).alias("effective_date"), F.when(F.col("o_custkey") % 5 == 0, F.date_add(F.to_date("o_orderdate"), shift + 9)).alias("expiry_date"), F.when((F.col("o_orderstatus") == "F") & (shift == 0), "invalid").otherwise("current").alias("validity_status"), source.cast("int").alias("source_page_start")]
    old, new = o.filter("o_orderkey % 2 = 0").select(cols(0, F.lit(None))), o.filter("o_orderkey % 3 = 0").select(cols(1, F.when(F.col("o_orderkey") % 9 == 0, 1)))
    reviews = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("policy_id"), F.lit("pending").alias("status"), F.lit("version_conflict").alias("issue_type"))
    out = P.upsert_documents(old, new, reviews, ["file_id"])
    return out.select("file_id", F.col("effective_date").cast("string").alias("effective_date"), F.col("expiry_date").cast("string").alias("expiry_date"), "validity_status")


def replace_clauses(spark, sf_dir):
    c = _clauses(spark, sf_dir).select("policy_id", "clause_id", "is_active", "structure_version")
    new = c.filter("policy_id < '3' AND structure_version = 'v1'").withColumn("structure_version", F.lit("v9")).withColumn("is_active", F.lit(True))
    return P.replace_clauses(c, new)


def backfill_names(spark, sf_dir):
    cat = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("file_name"))
    files = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("file_id"), F.when(F.col("p_size") % 3 > 0, F.upper("p_name")).alias("file_name"))
    return P.backfill_names(cat, files)


def family_candidates(spark, sf_dir):
    r = _relations(spark, sf_dir)
    cols = lambda df, first: df.filter("target_policy_id IS NOT NULL").select("source_policy_id", "target_policy_id", F.lit("same").alias("reason"), F.when(F.lit(first) | (F.col("relation_id") % 2 == 0), F.col("relation_id")).alias("relation_id"), F.when(F.col("relation_id") % 5 > 0, F.concat(F.lit("t"), F.col("relation_id") % 10)).otherwise("").alias("normalized_title"))
    return P.upsert_family_candidates(cols(r.filter("relation_id % 3 = 0"), False), cols(r.filter("relation_id % 3 = 1"), True))


def relation_counts(spark, sf_dir):
    return P.relation_counts(_relations(spark, sf_dir))


def date_conflicts(spark, sf_dir):
    return P.date_conflicts(_relations(spark, sf_dir))


def recompute_targets(spark, sf_dir):
    """Customers as documents; relations of keys divisible by three are deleted."""
    r = _relations(spark, sf_dir)
    days = r.filter("review_status = 'approved'").groupBy(F.col("target_policy_id").alias("policy_id")).agg(F.min("effective_date").alias("expiry_date"))
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("policy_id")).join(days, "policy_id", "left").withColumn("validity_status", F.when(F.col("expiry_date").isNotNull(), "invalid").otherwise("current"))
    reviews = d.filter("policy_id % 2 = 0").select("policy_id", F.lit("pending").alias("status"), F.lit("validity_conflict").alias("issue_type"))
    out = P.recompute_targets(d.select("policy_id", "expiry_date", "validity_status"), r, r.filter("relation_id % 3 = 0"), reviews)
    return out.withColumn("expiry_date", F.col("expiry_date").cast("string"))


def migrate_evidence(spark, sf_dir):
    c = _clauses(spark, sf_dir)
    r = c.select(F.col("clause_id").alias("relation_id"), F.col("policy_id").alias("source_policy_id"), F.substring_index("raw_text", ".", 1).alias("evidence_text"))
    return P.migrate_evidence(r, c)


def sample_manifest(spark, sf_dir):
    c = _clauses(spark, sf_dir)
    m = c.select("clause_id", F.sha2(F.when(F.col("sequence_no") % 2 == 0, F.col("raw_text")).otherwise("changed"), 256).alias("fingerprint"))
    return P.sample_ids(m, c).select("clause_id")


def match_context(spark, sf_dir):
    """Orders as matters with their parts, suppliers as matches with theirs."""
    li = table(spark, sf_dir, "lineitem")
    matters = li.groupBy(F.col("l_orderkey").alias("matter_id")).agg(F.collect_list("l_partkey").alias("clause_ids"))
    matches = li.filter("l_quantity > 48").groupBy(F.col("l_suppkey").alias("match_id")).agg(F.collect_list("l_partkey").alias("clause_ids"))
    return P.match_context(matches, matters)


def expand_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("clause_id"), (F.col("p_size") / 100).alias("score"))
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("clause_id"), F.col("p_partkey").alias("sequence_no"))
    return P.expand_candidates(c, m)


def review_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "supplier").select(F.lit("r").alias("run_id"), F.concat(F.lit("e"), "s_suppkey").alias("candidate_id"), F.when(F.col("s_acctbal") > 5000, "pending").when(F.col("s_acctbal") > 0, "auto_approved").otherwise("rejected").alias("review_status"), F.col("s_acctbal").alias("confidence"))
    r = table(spark, sf_dir, "nation").select(F.lit("r").alias("run_id"), F.concat(F.lit("n"), "n_nationkey").alias("candidate_id"), F.lit("pending").alias("review_status"), F.col("n_regionkey").cast("double").alias("confidence"))
    return P.review_candidates(e, r, "r")


def review_rows(spark, sf_dir):
    """Labels of every other turn with their clause and, of even conversations, their document."""
    c = _clauses(spark, sf_dir).select("clause_id", "policy_id", "sequence_no", "raw_text")
    labels = c.filter("sequence_no % 2 = 0").select("clause_id", F.lit("approved").alias("decision"))
    d = c.select("policy_id").distinct().filter("CAST(policy_id AS bigint) % 2 = 0").withColumn("title", F.concat(F.lit("t"), "policy_id"))
    return R.review_rows(labels, c, d).select("clause_id", "policy_id", "decision", "title", F.length("raw_text").alias("n_chars"))


def matter_members(spark, sf_dir):
    c = _clauses(spark, sf_dir).groupBy(F.col("policy_id").alias("matter_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence_no", "clause_id"))), lambda x: x["clause_id"]).alias("clause_ids"))
    return P.matter_members(c)


def page_ranges(spark, sf_dir):
    return P.page_ranges(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], "l_linenumber")


def latest_run(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("batch_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"), (F.col("o_orderkey") % 5 == 0).alias("is_sample"))
    return P.latest_run(o).select("run_id", "batch_id")


#: Parts of a brand as the items of a list; every third list is no list of kinds of documents.
TYPE_CLAUSES = """SELECT '' || p_partkey AS clause_id, p_brand || '-' || p_size AS parent_clause_id, CASE WHEN p_partkey % 7 = 0 THEN 'article' ELSE 'item' END AS level,
  '（' || p_size || '）' || p_type || CASE WHEN p_partkey % 5 = 0 THEN ' 适用' ELSE '。适用于' || p_name || '。' END AS raw_text FROM {part}
  UNION ALL SELECT DISTINCT p_brand || '-' || p_size, NULL, 'article', CASE WHEN p_size % 3 = 0 THEN '一般规定' ELSE p_brand || '公文种类包括：' END FROM {part}"""


def document_type_items(spark, sf_dir):
    return P.document_type_items(made(spark, sf_dir, TYPE_CLAUSES))


LABELS = """SELECT p_partkey AS id, p_size % 2 = 0 AS b, p_size % 3 = 0 AS c, p_size % 5 = 0 AS d, CASE p_partkey % 5 WHEN 0 THEN '义务、禁止' WHEN 1 THEN '其他，义务' WHEN 2 THEN p_brand WHEN 3 THEN ' 许可 ' ELSE '' END AS said FROM {part}"""


def label_words(spark, sf_dir):
    pick = F.array_compact(F.array(F.when(F.col("d"), "prohibition"), F.when(F.col("b"), "permission"), F.when(F.col("c"), "obligation")))
    return made(spark, sf_dir, LABELS).select("id", P.format_labels(pick).alias("shown"), F.array_join(P.parse_labels(F.col("said")), ",").alias("codes"))


#: Suppliers as papers of five blocks, with the abstract said in one of three ways.
PAPERS = """SELECT s_suppkey AS file_id, 1 AS page_num, o AS ordinal, CASE o WHEN 0 THEN 'On the matter of ' || s_name || ' and its kind ' || s_suppkey WHEN 1 THEN 'Ann Lee*, Bo R. Li and Cy Orr'
  WHEN 2 THEN CASE s_suppkey % 3 WHEN 0 THEN 'Abstract: ' || s_name || ' is looked at in this paper from many sides.' WHEN 1 THEN 'ABSTRACT' ELSE 'School of Things, ann' || s_suppkey || '@x.org' END
  WHEN 3 THEN s_name || ' is here described at some length, so that it is prose of over eighty characters, ' || s_suppkey || '.' WHEN 4 THEN 'Ann Lee, ann' || s_suppkey || '@x.org, Received 2021, doi 10.1000/AB-' || s_suppkey ELSE 'Introduction' END AS content,
  CASE WHEN o = 0 AND s_suppkey % 2 = 0 THEN 'title' ELSE 'text' END AS raw_type, CASE WHEN o = 0 THEN 1 WHEN o = 5 THEN 2 END AS text_level
  FROM {supplier} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS v(o)"""


def academic_metadata(spark, sf_dir):
    a = M.academic(M.paper_heads(made(spark, sf_dir, PAPERS), "file_id"), "file_id")
    said = lambda x: F.concat_ws(" ", x["normalized_name"], x["is_corresponding"].cast("string"), x["email"])
    return a.select("file_id", "title", "abstract", F.array_join(F.transform("authors", said), ";").alias("authors"), "year", "doi")


#: Customers as forms and policies.
HEADS = """SELECT c_custkey AS file_id, '姓名：张' || (c_custkey % 10) || ' 部门：' || c_mktsegment || ' 金额：1,' || (100 + c_custkey % 900) || '.5元' AS form,
  CASE c_custkey % 4 WHEN 0 THEN '发布机构：教务处' || chr(10) || '校发〔2023〕0' || c_custkey || '号' || chr(10) || '2023年5月' || (1 + c_custkey % 28) || '日' || chr(10) || '第一条 引用 校发〔2020〕1号'
  WHEN 1 THEN '文号：校字[2021]' || c_custkey || '号 按照 教发〔2019〕3号' WHEN 2 THEN '根据校发〔2023〕' || c_custkey || '号制定' || chr(10) || '第一章 总则 2020年1月1日' ELSE c_name END AS policy,
  c_name || ' Ann ' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN repeat('x', 600) ELSE ', ' END || ' a' || c_custkey || '@x.org b@y.cn' AS mail FROM {customer}"""


def author_emails(spark, sf_dir):
    h = made(spark, sf_dir, HEADS).select("file_id", F.col("mail").alias("head"), F.array(F.concat(F.lit("ann "), F.col("file_id")), F.lit("Cy")).alias("authors"))
    return M.author_emails(h, "file_id", "authors")


def form_metadata(spark, sf_dir):
    return M.form(made(spark, sf_dir, HEADS).select("file_id", F.col("form").alias("head")), "file_id")


def policy_metadata(spark, sf_dir):
    return M.policy(made(spark, sf_dir, HEADS).select("file_id", F.col("policy").alias("head")), "file_id").withColumn("issue_date", F.col("issue_date").cast("string"))


#: Parts as notices with two titles of their own in seven lines; where the size is odd one of them isn't there.
PARTS = """SELECT p_partkey AS file_id, '关于印发《甲类' || p_size || '管理办法》《乙规定》的通知' AS notice, page, o AS ordinal, CASE o WHEN 0 THEN '各单位：' WHEN 1 THEN '甲类' || p_size || '管理办法' WHEN 2 THEN '第一条 ' || p_name
  WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN '附件2：乙' ELSE '丙' END WHEN 4 THEN '规定' WHEN 5 THEN '一、' || p_type ELSE '完' END AS line
  FROM {part} CROSS JOIN (VALUES (0, 1), (1, 1), (2, 2), (3, 2), (4, 2), (5, 3), (6, 3)) AS v(o, page)"""


def document_parts(spark, sf_dir):
    return M.split_documents(made(spark, sf_dir, PARTS))


#: The same parts' titles: a notice's and, where one stands alone before the first clause, the document's.
def document_titles(spark, sf_dir):
    line = F.when((F.col("ordinal") == 0) & (F.col("file_id") % 3 == 0), F.col("notice")).otherwise(F.col("line"))
    rows = made(spark, sf_dir, PARTS).withColumn("line", line).groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "page", "line"))), lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"))).alias("lines"))
    own = M.confirmed_titles(F.transform("lines", lambda x: x["line"]))
    guessed = M.guess_title(F.lit("tmpabcdefgh.pdf"), F.lit(True), F.col("lines"))
    return rows.select("file_id", own["title"].alias("title"), own["notice_title"].alias("notice_title"), guessed.alias("guessed"))


def cleaned_json(spark, sf_dir):
    rows = made(spark, sf_dir, """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'no ' || event_id WHEN event_id % 3 = 1 THEN
      '{{"b": "<i>' || event_type || '</i>", "url": "<u>", "a": [{{"id": "<1>", "t": "y<br>"}}], "k": ' || props || '}}' END AS raw FROM {events}""")
    return M.clean_json(rows, "id", "raw")


def table_text(spark, sf_dir):
    rows = made(spark, sf_dir, "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE '<table><tr><td>' || p_name || '</td><td>' || p_size || '</td></tr><tr><td> ' || p_brand || '</td></tr></table>' END AS html FROM {part}")
    return rows.select("id", M.html_text(F.col("html")).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        clause_selections, extraction_selection, eligible_labels, active_clauses, batch_documents, upsert_documents, replace_clauses, backfill_names, family_candidates, relation_counts, date_conflicts, recompute_targets, migrate_evidence,
        sample_manifest, match_context, expand_candidates, review_candidates, review_rows, matter_members, page_ranges, latest_run, document_type_items, label_words, academic_metadata, author_emails, form_metadata, policy_metadata, document_parts, document_titles, cleaned_json, table_text,
    )
}
_SQZ = r"regexp_replace({}, '\s+', '', 'g')"
_HAS = r"regexp_replace({1}, '\s+', '', 'g') <> '' AND contains(regexp_replace({0}, '\s+', '', 'g'), regexp_replace({1}, '\s+', '', 'g'))"
SQL = {
    "clause_selections": f"WITH {_C} SELECT clause_id, level IN ('article', 'paragraph', 'item') AND trim(raw_text) <> '' AS searchable, level <> 'chapter' AND (trim(raw_text) <> '' OR trim(search_text) <> '') AS substantive FROM c",
    "extraction_selection": f"""WITH {_C} SELECT 'f' || CAST(policy_id AS BIGINT) % 7 AS file_name, policy_id, clause_id FROM c WHERE length(trim(search_text)) >= 20 AND level <> 'chapter' ORDER BY 1, 2, sequence_no""",
    "eligible_labels": f"WITH {_C} SELECT clause_id FROM c WHERE sequence_no % 2 = 0 AND length(raw_text) % 2 = 0 AND {_HAS.format('raw_text', "split_part(search_text, '.', 1)")}",
    "active_clauses": f"WITH {_C} SELECT policy_id, clause_id FROM c WHERE is_active AND structure_version = CASE WHEN CAST(policy_id AS BIGINT) % 2 = 0 THEN 'v1' ELSE 'v2' END",
    "batch_documents": """SELECT c_custkey AS file_id FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT coalesce(CASE WHEN event_id % 5 = 0 THEN user_id + 1 END, CASE WHEN event_id % 3 = 0 THEN user_id END) FROM events WHERE event_type <> 'error')""",
    "upsert_documents": """WITH v AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS e, CASE WHEN o_custkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 9 END AS x, o_orderstatus AS s, o_orderkey % 2 = 0 AS o, o_orderkey % 3 = 0 AS n FROM orders)
SELECT k AS file_id, CAST(CASE WHEN NOT n THEN e WHEN k % 9 = 0 OR NOT o THEN e + 1 ELSE coalesce(e, e + 1) END AS VARCHAR) AS effective_date, CAST(CASE WHEN NOT n THEN x WHEN k % 9 = 0 OR NOT o THEN x + 1 ELSE coalesce(x, x + 1) END AS VARCHAR) AS expiry_date,
CASE WHEN o AND s = 'F' THEN 'invalid' WHEN o AND n AND s = 'P' THEN 'unknown' ELSE 'current' END AS validity_status FROM v WHERE o OR n""",
    "replace_clauses": f"""WITH {_C}, t AS (SELECT DISTINCT policy_id FROM c WHERE policy_id < '3' AND structure_version = 'v1')
SELECT policy_id, clause_id, CASE WHEN policy_id IN (FROM t) THEN structure_version = 'v1' ELSE is_active END AS is_active, CASE WHEN policy_id IN (FROM t) AND structure_version = 'v1' THEN 'v9' ELSE structure_version END AS structure_version FROM c""",
    "backfill_names": "SELECT p_partkey AS file_id, CASE WHEN p_partkey % 2 = 0 AND p_size % 3 > 0 THEN upper(p_name) WHEN p_size > 10 THEN p_name END AS file_name FROM part",
    "family_candidates": f"""WITH {_R}, b AS (SELECT source_policy_id, target_policy_id, relation_id % 3 AS k, CASE WHEN relation_id % 3 = 1 OR relation_id % 2 = 0 THEN relation_id END AS relation_id, CASE WHEN relation_id % 5 > 0 THEN 't' || relation_id % 10 ELSE '' END AS t FROM r WHERE target_policy_id IS NOT NULL AND relation_id % 3 < 2)
SELECT source_policy_id, target_policy_id, 'same' AS reason, first(relation_id ORDER BY k, relation_id) FILTER (relation_id IS NOT NULL) AS relation_id, coalesce(first(t ORDER BY k, t) FILTER (t <> ''), '') AS normalized_title FROM b GROUP BY 1, 2""",
    "relation_counts": f"WITH {_R} SELECT count(*) AS total, count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status = 'rejected') AS rejected, count(target_policy_id) AS resolved, count(*) - count(target_policy_id) AS unresolved FROM r",
    "date_conflicts": f"WITH {_R} SELECT target_policy_id, count(DISTINCT effective_date) AS n_dates FROM r WHERE review_status = 'approved' AND target_policy_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT effective_date) > 1",
    "recompute_targets": f"""WITH {_R}, a AS (SELECT target_policy_id AS id, effective_date AS d, relation_id % 3 = 0 AS gone FROM r WHERE review_status = 'approved' AND target_policy_id IS NOT NULL),
g AS (SELECT id, min(d) AS first, count(*) FILTER (gone) AS lost, min(d) FILTER (NOT gone) AS left_day, list(d) FILTER (gone) AS lost_days FROM a GROUP BY 1),
x AS (SELECT c_custkey AS policy_id, first, lost, left_day, CASE WHEN coalesce(lost, 0) = 0 THEN first WHEN left_day IS NOT NULL THEN left_day WHEN list_contains(lost_days, first) THEN NULL ELSE first END AS e FROM customer LEFT JOIN g ON id = c_custkey)
SELECT policy_id, CAST(e AS VARCHAR) AS expiry_date, CASE WHEN coalesce(lost, 0) = 0 THEN CASE WHEN first IS NOT NULL THEN 'invalid' ELSE 'current' END WHEN e IS NOT NULL THEN 'invalid' WHEN policy_id % 2 = 0 THEN 'unknown' ELSE 'current' END AS validity_status FROM x""",
    "migrate_evidence": f"""WITH {_C}, e AS (SELECT clause_id AS relation_id, policy_id, {_SQZ.format("split_part(raw_text, '.', 1)")} AS e FROM c),
m AS (SELECT relation_id, min(clause_id) AS clause_id, count(*) AS n FROM e JOIN c USING (policy_id) WHERE e <> '' AND contains({_SQZ.format("raw_text")}, e) GROUP BY 1) SELECT relation_id, clause_id FROM m WHERE n = 1""",
    "sample_manifest": f"WITH {_C} SELECT clause_id FROM c WHERE sequence_no % 2 = 0",
    "match_context": """SELECT a.l_suppkey AS match_id, min(b.l_orderkey) AS matter_id FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_quantity > 48 GROUP BY 1""",
    "expand_candidates": """WITH c AS (SELECT p_partkey AS clause_id, p_size / 100.0::DOUBLE AS score FROM part WHERE p_size % 2 = 0),
n AS (SELECT p_partkey AS clause_id FROM part WHERE p_size % 2 = 1 ORDER BY 1 LIMIT 6)
SELECT clause_id, score, false AS expanded FROM c UNION ALL SELECT clause_id, round((SELECT max(score) FROM c) * 0.9::DOUBLE, 6), true FROM n""",
    "review_candidates": """WITH u AS (SELECT 'entity' AS kind, 'e' || s_suppkey AS candidate_id, CASE WHEN s_acctbal > 5000 THEN 'pending' WHEN s_acctbal > 0 THEN 'auto_approved' ELSE 'rejected' END AS review_status, s_acctbal AS confidence FROM supplier
UNION ALL SELECT 'relation', 'n' || n_nationkey, 'pending', CAST(n_regionkey AS DOUBLE) FROM nation)
SELECT * FROM u WHERE review_status <> 'rejected' ORDER BY CASE WHEN review_status = 'pending' THEN 0 ELSE 1 END, kind, confidence, candidate_id LIMIT 20""",
    "review_rows": f"WITH {_C} SELECT clause_id, policy_id, 'approved' AS decision, CASE WHEN CAST(policy_id AS BIGINT) % 2 = 0 THEN 't' || policy_id END AS title, CAST(length(raw_text) AS INTEGER) AS n_chars FROM c WHERE sequence_no % 2 = 0",
    "matter_members": f"WITH {_C} SELECT policy_id AS matter_id, CAST(row_number() OVER (PARTITION BY policy_id ORDER BY sequence_no) - 1 AS INTEGER) AS sequence_no, clause_id FROM c",
    "page_ranges": "SELECT l_orderkey, l_returnflag, min(l_linenumber) AS page_start, max(l_linenumber) AS page_end FROM lineitem GROUP BY 1, 2",
    "latest_run": "SELECT o_orderkey AS run_id, o_custkey AS batch_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "document_type_items": """SELECT '' || p_partkey AS clause_id, p_type AS name, p_name AS usage, '公文种类' AS category FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_size % 3 <> 0""",
    "label_words": f"""SELECT id, CASE WHEN c OR b OR d THEN array_to_string(list_filter([CASE WHEN c THEN '义务' END, CASE WHEN b THEN '许可' END, CASE WHEN d THEN '禁止' END], lambda x: x IS NOT NULL), '、') ELSE '' END AS shown,
CASE id % 5 WHEN 0 THEN 'obligation,prohibition' WHEN 3 THEN 'permission' WHEN 4 THEN '' END AS codes FROM ({as_duck(LABELS)})""",
    "academic_metadata": """SELECT s_suppkey AS file_id, 'On the matter of ' || s_name || ' and its kind ' || s_suppkey AS title,
CASE s_suppkey % 3 WHEN 0 THEN s_name || ' is looked at in this paper from many sides.' ELSE s_name || ' is here described at some length, so that it is prose of over eighty characters, ' || s_suppkey || '.' END AS abstract,
'Ann Lee* true ann' || s_suppkey || '@x.org;Bo R Li false;Cy Orr false ann' || s_suppkey || '@x.org' AS authors, '2021' AS year, '10.1000/AB-' || s_suppkey AS doi FROM supplier""",
    "author_emails": """SELECT c_custkey AS file_id, 'ann ' || c_custkey AS author, CASE WHEN c_custkey % 3 <> 0 THEN 'a' || c_custkey || '@x.org' END AS email FROM customer UNION ALL SELECT c_custkey, 'Cy', NULL FROM customer""",
    "form_metadata": """SELECT c_custkey AS file_id, '张' || c_custkey % 10 AS applicant, c_mktsegment AS department, '1' || (100 + c_custkey % 900) || '.5' AS amount FROM customer""",
    "policy_metadata": """SELECT c_custkey AS file_id, CASE c_custkey % 4 WHEN 0 THEN '校发〔2023〕' || c_custkey || '号' WHEN 1 THEN '校字〔2021〕' || c_custkey || '号' END AS doc_number, CASE WHEN c_custkey % 4 = 0 THEN '教务处' END AS issuer,
CASE WHEN c_custkey % 4 = 0 THEN '2023-05-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') END AS issue_date FROM customer""",
    "document_parts": """SELECT p_partkey AS file_id, 0 AS part_no, '甲类' || p_size || '管理办法' AS title, 1 AS page_start, 2 AS page_end, '甲类' || p_size || '管理办法' || chr(10) || '第一条 ' || p_name AS text FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 1, '乙规定', 2, 3, '附件2：乙' || chr(10) || '规定' || chr(10) || '一、' || p_type || chr(10) || '完' FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 0, '', 1, 3, '各单位：' || chr(10) || '甲类' || p_size || '管理办法' || chr(10) || '第一条 ' || p_name || chr(10) || '丙' || chr(10) || '规定' || chr(10) || '一、' || p_type || chr(10) || '完' FROM part WHERE p_size % 2 = 1""",
    "document_titles": """WITH t AS (SELECT p_partkey AS file_id, p_partkey % 3 = 0 AS n, p_size, '关于印发《甲类' || p_size || '管理办法》《乙规定》的通知' AS notice, '甲类' || p_size || '管理办法' AS own FROM part)
SELECT file_id, own AS title, CASE WHEN n THEN notice END AS notice_title, CASE WHEN NOT n THEN own WHEN p_size % 2 = 0 THEN '附件2：乙' ELSE notice END AS guessed FROM t""",
    "cleaned_json": """SELECT event_id AS id, CASE WHEN event_id % 3 = 1 THEN '{"a": [{"id": "<1>", "t": "y"}], "b": "' || event_type || '", "k": ' || props || ', "url": "<u>"}' END AS cleaned FROM events""",
    "table_text": """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_name || ' | ' || p_size || chr(10) || p_brand END AS text FROM part""",
}
