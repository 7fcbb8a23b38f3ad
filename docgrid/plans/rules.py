"""Rule engines and span grammars, on English words in the documents and on literal Chinese rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrid.functions import rules as R
from docgrid.functions import text as T
from docgrid.operators import extraction as E

from .common import as_duck, made, table

OWN = ("prose", "symbols", "licence")
OWN_RULES = [("prose", "text", r"\. ", 3, 2.5, False), ("prose", "text", r"(?i)\bthe\b", 5, 2.0, False), ("symbols", "text", r"[*&$%#]{3}", 10, 1.0, True), ("licence", "text", "Licen[sc]e", 1, 4.0, False)]


def document_types(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("pages", F.lit(1))
    return R.document_types(d, R.type_signals(d, "doc_id", "text", "source", "pages", OWN_RULES), "doc_id", OWN)


#: Parts as documents with Chinese words, by which each kind of signal is met by some.
TYPES = """SELECT p_partkey AS id, 'x' || p_partkey AS name, p_size AS pages, CASE p_partkey % 6
  WHEN 0 THEN '第一条 目的。第二条 范围。第三章 程序。本通知及办法。' || p_name WHEN 1 THEN 'see doi 10.1000/abc' || p_partkey
  WHEN 2 THEN '姓名 性别 年龄 学历 签名： ' || p_brand WHEN 3 THEN '甲方：' || p_name || chr(10) || '乙方：B' WHEN 4 THEN '普通文字' || p_type
  ELSE '教育部关于…印发。' || p_size END AS text FROM {part}"""


def chinese_document_types(spark, sf_dir):
    d = made(spark, sf_dir, TYPES)
    return R.document_types(d, R.type_signals(d, "id", "text", "name", "pages"), "id")


ROUTES = """SELECT c_custkey AS clause_id, CASE c_custkey % 7 WHEN 0 THEN '出差人员应当提交报销单，由财务处审批。' WHEN 1 THEN '为规范差旅管理，制定本办法。'
  WHEN 2 THEN c_mktsegment || ' 采购范围' WHEN 3 THEN ' ' WHEN 4 THEN '其他事项' || c_name WHEN 5 THEN '招标由供应商 提 交 文件' || c_custkey
  ELSE '自发布之日起 施行，' || c_name || ' 行程' END AS raw_text FROM {customer}"""


def process_routing(spark, sf_dir):
    d = made(spark, sf_dir, ROUTES)
    return R.route_processes(d, R.default_catalog(spark)).select("clause_id", "decision", F.array_join("domains", ",").alias("domains"), "confidence")


_ON, _LATER = "CAST(o_orderdate AS DATE)", "CAST('2024-02-05' AS DATE)"
QUESTIONS = f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN {_LATER} END AS asked, {_ON} AS d, CASE o_orderkey % 7 WHEN 0 THEN '' || {_ON} || ' 的规定'
  WHEN 1 THEN year(o_orderdate) || '年' || month(o_orderdate) || ' 月' || day(o_orderdate) || '日是否适用' WHEN 2 THEN '以前怎么报销' WHEN 3 THEN '现在怎么报销'
  WHEN 4 THEN '' || {_ON} || ' 和 ' || {_LATER} WHEN 5 THEN '' || {_ON} || ' 和 ' || {_ON} ELSE year(o_orderdate) || '年的规定' END AS q FROM {{orders}}"""


def answer_dates(spark, sf_dir):
    d = made(spark, sf_dir, QUESTIONS)
    a = R.answer_date(F.col("q"), F.col("asked"), F.lit("2025-05-05").cast("date"))
    return d.select("id", a.alias("a")).select("id", F.col("a.as_of").cast("string").alias("as_of"), "a.source")


NAMES = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'tmpabcdef' || p_partkey || '.pdf' WHEN 1 THEN p_name || '.pdf' WHEN 2 THEN '0123456789abcdef.PDF'
  WHEN 3 THEN 'download (' || p_size || ').pdf' WHEN 4 THEN 'document.pdf' ELSE '' END AS name, CASE WHEN p_partkey % 7 = 0 THEN 'a' WHEN p_partkey % 7 = 1 THEN ' .A:  ' || p_type || '?.pdf' ELSE p_type END AS title FROM {part}"""


def display_names(spark, sf_dir):
    d = made(spark, sf_dir, NAMES)
    return d.select("id", R.display_name(F.col("name"), F.col("title")).alias("shown"), R.low_confidence_name(F.col("name")).alias("low"))


def image_classes(spark, sf_dir):
    """Parts as images: size times twenty wide, price high."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20).alias("w"), (F.col("p_retailprice") / 3).cast("int").alias("h"))
    return p.select("p_partkey", R.image_class(F.col("w"), F.col("h")).alias("category"))


#: Orders as clauses, with numbers and words of the order in them.
CLAUSES = """SELECT o_orderkey AS clause_id, CASE o_orderkey % 9
  WHEN 0 THEN '住宿费不超过' || o_custkey || '元，申请人应当在' || (o_orderkey % 90) || '日内提交发票、' || o_orderpriority || '和其他凭证，由财务处审核。'
  WHEN 1 THEN '教职工出差申请须经人事部批准；每人每天' || (o_custkey % 500) || '.5 万元，提供：' || o_orderstatus || '证明以及材料' || o_custkey || '、限额2元、其他'
  WHEN 2 THEN '依据《会计法》（第' || o_custkey || '号）制定本办法，另见《出差' || o_orderpriority || '规定》' || chr(10) || '《旧法' || o_orderkey || '》已修订，由新法替代'
  WHEN 3 THEN '总则。自2024年1月' || (1 + o_orderkey % 28) || '日起施行。原《差旅费 管理办法》（校发〔2019〕0' || o_custkey || '号）、《出差' || o_orderpriority || '》，同时废止。附则' || o_custkey
  WHEN 4 THEN '《采购规定' || o_custkey || '》不得废止。' WHEN 5 THEN '一。同时废止《合同办法' || o_custkey || '》和《旧规定》。'
  WHEN 6 THEN '《合同办法' || o_custkey || '》（1号）第三条废止' WHEN 7 THEN '' ELSE '不得废止《采购规定' || o_custkey || '》' END AS raw_text FROM {orders}"""


def abolitions(spark, sf_dir):
    return E.abolition_candidates(made(spark, sf_dir, CLAUSES)).withColumn("effective_date", F.col("effective_date").cast("string"))


def references(spark, sf_dir):
    return E.reference_relations(made(spark, sf_dir, CLAUSES))


def rule_entities(spark, sf_dir):
    return E.rule_entities(made(spark, sf_dir, CLAUSES))


def evidence_supported(spark, sf_dir):
    """Whether a document's first sentence, white space taken out, stands in the next document."""
    d = table(spark, sf_dir, "documents")
    pairs = d.alias("a").join(d.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1)
    return pairs.select(F.col("a.doc_id").alias("doc_id"), T.evidence_supported(F.substring_index("a.text", ".", 1), F.col("b.text")).alias("supported"))


PAYLOADS = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'text ' || props || ' and {{"b": ' || event_id || '}} tail'
  WHEN 2 THEN event_type END AS raw FROM {events}"""


def json_payloads(spark, sf_dir):
    return made(spark, sf_dir, PAYLOADS).select("id", T.json_payload(F.col("raw")).alias("payload"))


def repaired_texts(spark, sf_dir):
    """Documents whose UTF-8 was read as Latin-1, put right."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return d.select("doc_id", F.md5(R.mojibake(broken).cast("binary")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (document_types, chinese_document_types, process_routing, answer_dates, display_names, image_classes, abolitions, references, rule_entities, evidence_supported, json_payloads, repaired_texts)}


def _says(words):
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words.split("|")) + ")"


SQL = {
    "document_types": """WITH s AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\\. ')) >= 3 THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '(?i)\\bthe\\b')) >= 5 THEN 2.0::DOUBLE ELSE 0 END AS p,
 len(regexp_extract_all(text, '[*&$%#]{3}')) >= 10 AS strong, CASE WHEN regexp_matches(text, 'Licen[sc]e') THEN 4.0::DOUBLE ELSE 0 END AS l FROM documents),
t AS (SELECT *, greatest(p, l) AS top, least(p, l) AS second FROM s)
SELECT doc_id, CASE WHEN strong THEN 'symbols' WHEN top >= 3.5 AND top - second >= 2 THEN CASE WHEN p >= l THEN 'prose' ELSE 'licence' END ELSE 'other' END AS doc_type,
CASE WHEN strong THEN 1.0::DOUBLE WHEN top >= 3.5 AND top - second >= 2 THEN round_even(least(0.5::DOUBLE + 0.5::DOUBLE * (1 - exp(-top / 5)) + 0.15::DOUBLE * (1 - exp(-(top - second) / 3)), 1.0::DOUBLE), 3) ELSE 0.0::DOUBLE END AS confidence FROM t""",
    "chinese_document_types": f"""WITH d AS ({as_duck(TYPES)}), s AS (SELECT id, id % 6 AS k, pages,
 CASE WHEN id % 6 = 0 THEN 4.5::DOUBLE ELSE 0 END AS policy, CASE WHEN pages BETWEEN 5 AND 50 THEN 1.0::DOUBLE ELSE 0 END AS paper,
 CASE WHEN id % 6 = 2 THEN 3.5::DOUBLE ELSE 0 END + CASE WHEN pages BETWEEN 1 AND 5 THEN 1.5::DOUBLE ELSE 0 END AS form FROM d),
t AS (SELECT *, greatest(policy, paper, form) AS top, list_sort([policy, paper, form, 0])[-2] AS second FROM s)
SELECT id, CASE WHEN k = 1 THEN 'academic_paper' WHEN k = 5 THEN 'policy_regulation' WHEN k = 3 THEN 'contract' WHEN top >= 3.5 AND top - second >= 2 THEN CASE WHEN top = policy THEN 'policy_regulation' ELSE 'admin_form' END ELSE 'other' END AS doc_type,
CASE WHEN k IN (1, 3, 5) THEN 1.0::DOUBLE WHEN top >= 3.5 AND top - second >= 2 THEN round_even(least(0.5::DOUBLE + 0.5::DOUBLE * (1 - exp(-top / 5)) + 0.15::DOUBLE * (1 - exp(-(top - second) / 3)), 1.0::DOUBLE), 3) ELSE 0.0::DOUBLE END AS confidence FROM t""",
    "process_routing": f"""WITH c AS (SELECT clause_id, regexp_replace(raw_text, '\\s+', '', 'g') AS t FROM ({as_duck(ROUTES)})),
d AS (SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN {_says(w)} THEN '{k}' END" for k, w in sorted(R.DOMAINS))}], lambda x: x IS NOT NULL), ',') AS named, {_says(R.PROCESS_WORDS)} AS signal, {_says(R.EXCLUDE_WORDS)} AS excluded FROM c),
e AS (SELECT *, CASE WHEN t = '' THEN 'non_process' WHEN named <> '' AND signal THEN 'process' WHEN excluded OR named = '' THEN 'non_process' ELSE 'pending' END AS decision FROM d)
SELECT clause_id, decision, CASE decision WHEN 'non_process' THEN '' ELSE named END AS domains, CASE WHEN t = '' THEN 1.0::DOUBLE WHEN named <> '' AND signal THEN 0.96 WHEN excluded THEN 0.98 WHEN named <> '' THEN 0.5 ELSE 0.95 END AS confidence FROM e""",
    "answer_dates": f"""WITH q AS (SELECT *, id % 7 AS k FROM ({as_duck(QUESTIONS)}))
SELECT id, CAST(CASE WHEN asked IS NOT NULL THEN asked WHEN k IN (0, 1, 5) THEN d WHEN k = 3 THEN DATE '2025-05-05' END AS VARCHAR) AS as_of,
CASE WHEN asked IS NOT NULL THEN 'request' WHEN k IN (0, 1, 5) THEN 'question' WHEN k = 3 THEN 'today' ELSE 'ambiguous' END AS source FROM q""",
    "display_names": f"""WITH n AS (SELECT *, id % 6 <> 1 AS low, trim(regexp_replace(regexp_replace(trim(title), '\\s+', ' ', 'g'), '[<>:"/\\\\|?*]', '', 'g'), '. ') AS clean FROM ({as_duck(NAMES)}))
SELECT id, CASE WHEN low AND length(clean) BETWEEN 3 AND 180 THEN CASE WHEN lower(clean) LIKE '%.pdf' THEN clean ELSE clean || '.pdf' END ELSE trim(name) END AS shown, low FROM n""",
    "image_classes": """WITH p AS (SELECT p_partkey, p_size * 20 AS w, CAST(floor(p_retailprice / 3) AS INTEGER) AS h FROM part)
SELECT p_partkey, CASE WHEN w < 100 AND h < 100 THEN 'icon' WHEN greatest(w, h)::DOUBLE / greatest(least(w, h), 1) > 5 THEN 'seal' WHEN least(w, h) >= 300 AND greatest(w, h)::DOUBLE / least(w, h) < 1.25 THEN 'chart' ELSE 'photo' END AS category FROM p""",
    "abolitions": """WITH o AS (SELECT o_orderkey AS clause_id, o_orderkey % 9 AS k, o_custkey AS c, o_orderpriority AS p, 1 + o_orderkey % 28 AS d FROM orders),
e AS (SELECT *, '自2024年1月' || d || '日起施行。原《差旅费 管理办法》（校发〔2019〕0' || c || '号）、《出差' || p || '》，同时废止。' AS long, '同时废止《合同办法' || c || '》和《旧规定》。' AS short, '2024-01-' || lpad(CAST(d AS VARCHAR), 2, '0') AS day FROM o)
SELECT clause_id, 0 AS ordinal, '差旅费管理办法' AS target_title, '校发〔2019〕' || c || '号' AS target_doc_number, day AS effective_date, long AS evidence FROM e WHERE k = 3
UNION ALL SELECT clause_id, 1, '出差' || replace(p, ' ', ''), '', day, long FROM e WHERE k = 3
UNION ALL SELECT clause_id, 0, '合同办法' || c, '', NULL, short FROM e WHERE k = 5 UNION ALL SELECT clause_id, 1, '旧规定', '', NULL, short FROM e WHERE k = 5""",
    "references": f"""WITH c AS (SELECT clause_id, raw_text AS t, regexp_extract_all(raw_text, '{E.CITED}') AS q, string_split_regex(raw_text, '{E.CITED}') AS p FROM ({as_duck(CLAUSES)})),
b AS (SELECT clause_id, t, list_transform(range(1, len(q) + 1), lambda i: {{'k': i, 'q': q[i], 'b': right(array_to_string(list_transform(range(1, i + 1), lambda j: coalesce(q[j - 1], '') || p[j]), ''), 8)}}) AS r FROM c),
u AS (SELECT clause_id, unnest(r, recursive := true) FROM b),
a AS (SELECT clause_id, k, CASE WHEN regexp_matches(b, '依据|根据|按照') THEN 'based_on' ELSE 'cites' END AS relation_type, q AS target, 0.98::DOUBLE AS confidence FROM u
  UNION ALL SELECT clause_id, 1000 + n, kind, trim(regexp_extract(t, '[^\\n]{{0,30}}' || w || '[^\\n]{{0,50}}'), ' ，,。；;'), 0.9::DOUBLE FROM c, (VALUES (1, 'revises', '修订'), (2, 'abolishes', '废止'), (3, 'replaces', '替代')) v(n, kind, w) WHERE contains(t, w))
SELECT clause_id, CAST(row_number() OVER (PARTITION BY clause_id ORDER BY k) - 1 AS INTEGER) AS ordinal, relation_type, target, confidence FROM a""",
    "rule_entities": f"""WITH c AS (SELECT clause_id, raw_text AS t FROM ({as_duck(CLAUSES)})),
l AS (SELECT clause_id, unnest(regexp_extract_all(t, '{E.MATERIALS}', 1)) AS said, unnest(range(len(regexp_extract_all(t, '{E.MATERIALS}', 1)))) AS n FROM c),
i AS (SELECT clause_id, n, [trim(x, ' ' || chr(9) || chr(13) || chr(10) || '：:()（）【】[]') FOR x IN string_split_regex(trim(said, '{E.TRIM}、'), '{E.MATERIAL_SPLIT}')] AS items FROM l),
m AS (SELECT clause_id, n, items[:coalesce(nullif(list_position([regexp_matches(x, '{E.MATERIAL_END}') FOR x IN items], true), 0) - 1, len(items))] AS items FROM i),
a AS (
  SELECT clause_id, 1 AS rule, unnest(range(len(regexp_extract_all(t, '{E.AMOUNT}')))) AS n, 0 AS k, 'amount' AS kind, unnest(regexp_extract_all(t, '{E.AMOUNT}', 2)) AS v, unnest(regexp_extract_all(t, '{E.AMOUNT}', 3)) AS u, trim(unnest(regexp_extract_all(t, '{E.AMOUNT}', 1)), '{E.TRIM}') AS e FROM c
  UNION ALL SELECT clause_id, 2, unnest(range(len(regexp_extract_all(t, '{E.DEADLINE}')))), 0, 'deadline', unnest(regexp_extract_all(t, '{E.DEADLINE}', 2)), unnest(regexp_extract_all(t, '{E.DEADLINE}', 3)), trim(unnest(regexp_extract_all(t, '{E.DEADLINE}', 1)), '{E.TRIM}') FROM c),
f AS (
  SELECT clause_id, rule, n, k, kind, v || coalesce(nullif(u, ''), '元') AS name, e, CAST(v AS DOUBLE) AS value, coalesce(nullif(u, ''), '元') AS unit FROM a
  UNION ALL SELECT clause_id, 3, unnest(range(len(regexp_extract_all(t, '{E.DEPARTMENT}')))), 0, 'department', regexp_replace(unnest(regexp_extract_all(t, '{E.DEPARTMENT}')), '{E.DEPARTMENT_PREFIX}', ''), unnest(regexp_extract_all(t, '{E.DEPARTMENT}')), NULL, NULL FROM c
  UNION ALL SELECT clause_id, 4, n, 0, 'audience', w, w, NULL, NULL FROM c, (VALUES {', '.join(f"({k}, '{w}')" for k, w in enumerate(E.AUDIENCES))}) x(n, w) WHERE contains(t, w)
  UNION ALL SELECT clause_id, 5, n, unnest(range(len(items))), 'material', unnest(items), unnest(items), NULL, NULL FROM m
  UNION ALL SELECT clause_id, 6, n, 0, 'approval_action', w, w, NULL, NULL FROM c, (VALUES {', '.join(f"({k}, '{w}')" for k, w in enumerate(E.ACTIONS))}) x(n, w) WHERE contains(t, w)
  UNION ALL SELECT clause_id, 7, unnest(range(len(regexp_extract_all(t, '{E.MATTER}')))), 0, 'matter', unnest(regexp_extract_all(t, '{E.MATTER}')), unnest(regexp_extract_all(t, '{E.MATTER}')), NULL, NULL FROM c),
g AS (SELECT * FROM f WHERE name <> '' AND e <> '' AND (rule <> 5 OR length(name) <= 40 AND name NOT IN ('相关材料', '有关材料', '如下')) QUALIFY row_number() OVER (PARTITION BY clause_id, kind, name, e ORDER BY rule, n, k) = 1)
SELECT clause_id, CAST(row_number() OVER (PARTITION BY clause_id ORDER BY rule, n, k) - 1 AS INTEGER) AS ordinal, kind AS entity_type, name, e AS evidence, value, unit, 0.98::DOUBLE AS confidence FROM g""",
    "evidence_supported": """SELECT a.doc_id, e <> '' AND contains(regexp_replace(b.text, '\\s+', '', 'g'), e) AS supported FROM (SELECT doc_id, regexp_replace(split_part(text, '.', 1), '\\s+', '', 'g') AS e FROM documents) a JOIN documents b ON b.doc_id = a.doc_id + 1""",
    "json_payloads": f"""SELECT id, CASE id % 4 WHEN 0 THEN props WHEN 1 THEN props || ' and {{"b": ' || id || '}}' END AS payload FROM (SELECT id, props FROM (SELECT event_id AS id, props FROM events))""",
    "repaired_texts": "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL",
}
