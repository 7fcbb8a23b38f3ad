"""Section assembly, budgets, siblings and chunks, on conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrid.operators import sections as S

from .common import as_duck, made, table


def section_assembly(spark, sf_dir):
    """A user's turn begins a section of its conversation."""
    c = table(spark, sf_dir, "conversations")
    out = S.assemble(c, "conv_id", ["turn"], "text", F.col("role") == "user")
    return out.select("conv_id", "section_no", "n_blocks", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def document_sections(spark, sf_dir):
    """Lines of documents; one that ends in a full stop after fewer than 40 characters begins a section."""
    lines = S.policy_lines(table(spark, sf_dir, "documents"), "doc_id", [], "text")
    out = S.assemble(lines, "doc_id", ["line_no"], "line", (F.length("line") < 40) & F.col("line").endswith("."))
    return out.select("doc_id", "section_no", "n_blocks", F.length("text").alias("n_chars"))


def prefix_budget(spark, sf_dir):
    out = S.prefix_budget(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", 1500)
    return out.select("conv_id", "turn", F.length("kept").alias("kept_chars"), F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


def siblings_prev_next(spark, sf_dir):
    return S.siblings(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role").select("conv_id", "turn", "previous", "next")


def chunk_documents(spark, sf_dir):
    return S.chunk_documents(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "chunk_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def page_merge(spark, sf_dir):
    """All turns of a conversation as one unit."""
    out = S.assemble(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", F.lit(False))
    return out.select("conv_id", F.length("text").alias("n_chars"), "n_blocks")


#: Suppliers as two blocks of numbered lines.
NUMBERED = """SELECT s_suppkey AS doc, o AS ordinal, CASE WHEN o = 0 THEN '总则' || s_name || chr(10) || '一、目的' || chr(10) || '为规范管理' || s_suppkey || chr(10) || '（一）范围' || chr(10) || '3.14不是标题' || chr(10) || '1.1 细则'
  WHEN s_suppkey % 2 = 0 THEN '第一章 采购' || chr(10) || '正文' || s_suppkey ELSE '1、首项' || chr(10) || '说明' || s_suppkey END AS text FROM {supplier} CROSS JOIN (VALUES (0), (1)) AS v(o)"""


def policy_headings(spark, sf_dir):
    lines = S.policy_lines(made(spark, sf_dir, NUMBERED), "doc", ["ordinal"], "text")
    return S.assemble(lines, "doc", ["ordinal", "line_no"], "line", F.col("line").rlike(S.POLICY_HEADING)).select("doc", "section_no", "text")


#: Suppliers as the lines of a paper and of a regulation.
HEADED = """SELECT s_suppkey AS doc, o AS ordinal, CASE o WHEN 0 THEN s_name WHEN 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'Abstract' ELSE '第一条 目的' END WHEN 2 THEN 'text ' || s_suppkey WHEN 3 THEN CASE WHEN s_suppkey % 2 = 0 THEN '2. Methods' ELSE '第十二条 范围' END
  WHEN 4 THEN '  ' ELSE '第 1 条 of ' || s_suppkey END AS line FROM {supplier} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS v(o)"""


def paper_sections(spark, sf_dir):
    return S.assemble(made(spark, sf_dir, HEADED), "doc", ["ordinal"], "line", F.col("line").rlike(S.ACADEMIC_HEADING))


def article_sections(spark, sf_dir):
    return S.assemble(made(spark, sf_dir, HEADED), "doc", ["ordinal"], "line", F.col("line").rlike(S.ARTICLE_HEADING))


_SECTIONS = r"""WITH l AS (SELECT * FROM ({rows}) WHERE trim(line) <> ''), s AS (SELECT *, CAST(sum(CASE WHEN ordinal = 0 OR regexp_matches(line, '{heading}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ordinal) AS BIGINT) AS section_no FROM l)
SELECT doc, section_no, string_agg(line, chr(10) ORDER BY ordinal) AS text, count(*) AS n_blocks FROM s GROUP BY 1, 2"""

QUERIES = {f.__name__: f for f in (section_assembly, document_sections, prefix_budget, siblings_prev_next, chunk_documents, page_merge, policy_headings, paper_sections, article_sections)}
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SQL = {
    "section_assembly": f"""WITH b AS (SELECT conv_id, turn, {_STRIP.format("text")} AS t, role FROM conversations WHERE {_STRIP.format("text")} <> ''),
s AS (SELECT *, CASE WHEN role = 'user' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS st FROM b),
n AS (SELECT *, CAST(sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section_no FROM s)
SELECT conv_id, section_no, count(*) AS n_blocks, md5(string_agg(t, chr(10) ORDER BY turn)) AS text_md5 FROM n GROUP BY 1, 2""",
    "document_sections": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
b AS (SELECT doc_id, line_no, line, {_STRIP.format("line")} AS t FROM l WHERE {_STRIP.format("line")} <> ''),
s AS (SELECT *, CASE WHEN (length(line) < 40 AND line LIKE '%.') OR row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1 THEN 1 ELSE 0 END AS st FROM b),
n AS (SELECT *, CAST(sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section_no FROM s)
SELECT doc_id, section_no, count(*) AS n_blocks, CAST(length(string_agg(t, chr(10) ORDER BY line_no)) AS INTEGER) AS n_chars FROM n GROUP BY 1, 2""",
    "prefix_budget": """WITH u AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations)
SELECT conv_id, turn, CAST(length(k) AS INTEGER) AS kept_chars, md5(k) AS kept_md5 FROM (SELECT conv_id, turn, substr(text, 1, CAST(1500 - used AS BIGINT)) AS k FROM u WHERE used < 1500)""",
    "siblings_prev_next": "SELECT conv_id, turn, lag(role) OVER w AS previous, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "chunk_documents": f"""WITH pp AS (SELECT doc_id, list_filter([{_STRIP.format("x")} FOR x IN string_split(text, chr(10))], lambda x: x <> '') AS ps FROM documents),
f AS (SELECT doc_id, list_reduce(ps, lambda acc, p: CASE
    WHEN length(acc.cur) + length(p) + 1 <= 512 THEN {{'cur': CASE WHEN acc.cur = '' THEN p ELSE acc.cur || chr(10) || p END, 'done': acc.done}}
    WHEN length(p) > 512 THEN {{'cur': '', 'done': list_concat(CASE WHEN acc.cur <> '' THEN list_append(acc.done, acc.cur) ELSE acc.done END, [substr(p, s + 1, 512) FOR s IN range(0, length(p), 462)])}}
    ELSE {{'cur': p, 'done': CASE WHEN acc.cur <> '' THEN list_append(acc.done, acc.cur) ELSE acc.done END}} END, {{'cur': '', 'done': []::VARCHAR[]}}) AS a FROM pp),
c AS (SELECT doc_id, CASE WHEN a.cur <> '' THEN list_append(a.done, a.cur) ELSE a.done END AS cs FROM f),
e AS (SELECT doc_id, unnest(cs) AS t, CAST(unnest(range(len(cs))) AS INTEGER) AS chunk_index FROM c)
SELECT doc_id, chunk_index, doc_id || '_chunk_' || chunk_index AS chunk_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM e""",
    "page_merge": f"""SELECT conv_id, CAST(length(string_agg({_STRIP.format("text")}, chr(10) ORDER BY turn)) AS INTEGER) AS n_chars, count(*) AS n_blocks FROM conversations WHERE {_STRIP.format("text")} <> '' GROUP BY 1""",
    "paper_sections": _SECTIONS.format(rows=as_duck(HEADED), heading=S.ACADEMIC_HEADING),
    "article_sections": _SECTIONS.format(rows=as_duck(HEADED), heading=S.ARTICLE_HEADING),
    "policy_headings": """SELECT s_suppkey AS doc, CAST(n AS BIGINT) AS section_no, CASE n WHEN 1 THEN '总则' || s_name WHEN 2 THEN '一、目的' || chr(10) || '为规范管理' || s_suppkey WHEN 3 THEN '（一）范围' || chr(10) || '3.14不是标题' WHEN 4 THEN '1.1 细则'
WHEN 5 THEN CASE WHEN s_suppkey % 2 = 0 THEN '第一章 采购' || chr(10) || '正文' || s_suppkey ELSE '1、首项' || chr(10) || '说明' || s_suppkey END END AS text FROM supplier, range(1, 6) x(n)""",
}
