"""Rule engines: document types, process routing, answer dates, names, images.  Rules are rows, so they can be replaced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.functions.text import is_blank, squash, strip, text_or_blank

# Signals of document types as (category, field, pattern, least matches, weight, strong).
CATEGORIES = ("academic_paper", "policy_regulation", "admin_form", "contract")
TYPE_RULES = [
    ("academic_paper", "text", r"(?i)(?:https?://doi\.org/)?10\.\d{4,9}/[-._;()/:A-Z0-9]+", 1, 1.0, True),
    ("academic_paper", "text", r"(?i)arXiv\s*:\s*\d{4}\.\d{4,5}(?:v\d+)?", 1, 1.0, True),
    ("academic_paper", "text", r"(?i)PMID\s*:\s*\d{7,8}|PMCID\s*:\s*PMC\d+", 1, 1.0, True),
    ("academic_paper", "text", r"(?i)(?:Received|Revised|Accepted|Published).*?\d{4}|(?:收稿日期|修回日期|录用日期).*?\d{4}", 1, 1.0, True),
    ("academic_paper", "text", r"\[\d{1,2}\]", 10, 1.0, True),
    ("academic_paper", "text", r"(?i)(?:Journal|Vol\.?|Volume)\s*\d+.*(?:No\.?|Issue)\s*\d+", 1, 1.0, True),
    ("academic_paper", "text", r"(?:Fig\.|Figure|Table|图\s*\d|表\s*\d)", 3, 2.0, False),
    ("academic_paper", "name", r"(?i)论文|学报|journal|thesis|dissertation|paper|review", 1, 1.0, False),
    ("policy_regulation", "text", r"[\x{4e00}-\x{9fa5}]{2,12}[〔\[［﹝【](?:19|20)\d{2}[〕\]］﹞】]\d+号", 1, 1.0, True),
    ("policy_regulation", "name", r"关于印发[《〈].{1,100}(?:办法|规定|条例|细则|制度|意见)[》〉]的通知", 1, 1.0, True),
    ("policy_regulation", "text", r"(?:国务院|中共中央|教育部|发改委|人民政府|办公厅).{0,15}印发", 1, 1.0, True),
    ("policy_regulation", "text", r"现印发给你们|请认真贯彻执行|请遵照执行|特此通知|此令", 1, 1.0, True),
    ("policy_regulation", "text", r"第[一二三四五六七八九十百\d]+[章条]", 3, 2.5, False),
    ("policy_regulation", "text", r"(?:自|于)\d{4}年\d{1,2}月\d{1,2}日(?:起?施行|实施|生效)", 1, 1.5, False),
    ("policy_regulation", "text", r"(?m)^\s*[\x{4e00}-\x{9fa5}]{2,12}(?:厅|局|委|办|部|署|会|院|校|政府)", 1, 1.5, False),
    ("policy_regulation", "name", r"办法|规定|通知|意见|批复|条例|细则|制度", 1, 1.0, False),
    ("admin_form", "text", r"[□☑☐]", 5, 1.0, True),
    ("admin_form", "name", r"(申请|登记|审批|报名|调查|备案|统计|申报|测评|考核)[表册]", 1, 1.0, True),
    ("admin_form", "text", r"[_]{3,}", 10, 1.0, True),
    ("admin_form", "text", r"(?:签名|签字)[：:]|(?:盖章|公章)[：:]|填表日期", 1, 1.0, False),
    ("admin_form", "name", r"(?i)表$|表格|form", 1, 0.5, False),
    ("contract", "text", r"(?s)甲方[：:].*?乙方[：:]", 1, 1.0, True),
    ("contract", "text", r"本合同一式|（盖章）", 1, 0.8, False),
]
#: (category, words, how many of them, weight): counted once each.
WORD_RULES = [
    ("academic_paper", "abstract|introduction|keywords|references|materials and methods|results|discussion|conclusion|experiments|摘要|关键词|引言|材料与方法|结果|讨论|参考文献|结论".split("|"), 3, 2.5),
    ("policy_regulation", "通知|规定|办法|条例|细则|意见|决定|公告|批复|令".split("|"), 2, 2.0),
    ("admin_form", "姓名|性别|年龄|出生年月|身份证号|联系电话|电子邮箱|通讯地址|邮政编码|学历|学位|职称|工作单位".split("|"), 4, 2.5),
]
#: (category, fewest pages, most pages, weight).
PAGE_RULES = [("academic_paper", 5, 50, 1.0), ("admin_form", 1, 5, 1.5)]
DOMAINS = [("reimbursement", "报销|报账|费用结算|报销单|发票|票据"), ("travel", "出差|差旅|差旅费|交通费|住宿费|行程"), ("procurement", "采购|购置|招标|询价|供应商")]
PROCESS_WORDS = "申请|提交|提供|报送|审批|审核|批准|办理|支付|结算|备案|验收|退回|补充"
EXCLUDE_WORDS = "总则|为加强|为规范|制定本办法|制定本规定|制定本细则|解释权|自发布之日起|自印发之日起|本办法由|认真执行"
ISO_DATE = r"(?<!\d)(\d{4}-\d{1,2}-\d{1,2})(?!\d)"
CN_DATE = r"(?<!\d)\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}(?=\s*日)"
HISTORY = r"(?:\d{4}\s*年|当时|以前|此前|原来|原先|旧办法|旧规定|历史上)"
LOW_CONFIDENCE_NAME = r"^(?:tmp[a-z0-9_-]{6,}|(?:pdf_)?[0-9a-f]{16,}|(?:download|document|untitled|file|unknown)(?:[ _-]?\d+|\s*\(\d+\))?)\.pdf$"
CATALOG = "domain string, kind string, keyword string, enabled boolean"
LEAST_SCORE, LEAST_LEAD = 3.5, 2.0


def type_signals(docs: DataFrame, key: str, text: str, name: str, pages: str, rules: list[tuple] = TYPE_RULES) -> DataFrame:
    """key, category, weight, strong: one row for each rule that a document meets.  All rules in one pass."""
    fields = {"text": text_or_blank(F.col(text)), "name": text_or_blank(F.col(name))}
    hits = []
    for category, field, pattern, least, weight, strong in rules:
        met = F.rlike(fields[field], F.lit(pattern)) if least == 1 else F.regexp_count(fields[field], F.lit(pattern)) >= least
        hits.append(F.when(met, F.struct(F.lit(category).alias("category"), F.lit(weight).alias("weight"), F.lit(strong).alias("strong"))))
    low = F.lower(fields["text"])
    for category, words, least, weight in WORD_RULES if rules is TYPE_RULES else []:
        n = reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])
        hits.append(F.when(n >= least, F.struct(F.lit(category).alias("category"), F.lit(weight).alias("weight"), F.lit(False).alias("strong"))))
    for category, few, many, weight in PAGE_RULES if rules is TYPE_RULES else []:
        hits.append(F.when(F.col(pages).between(few, many), F.struct(F.lit(category).alias("category"), F.lit(weight).alias("weight"), F.lit(False).alias("strong"))))
    return docs.select(key, F.explode(F.array_compact(F.array(*hits))).alias("s")).select(key, "s.*")


def confidence(top: Column, second: Column) -> Column:
    """0 below the least score, else 0.5 to 1 by the score and its lead."""
    c = 0.5 + 0.5 * (1 - F.exp(-top / 5)) + 0.15 * (1 - F.exp(-(top - second) / 3))
    return F.when(top < LEAST_SCORE, F.lit(0.0)).otherwise(F.bround(F.least(c, F.lit(1.0)), 3))


def document_types(docs: DataFrame, signals: DataFrame, key: str, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """key, doc_type, confidence: a strong signal decides by priority, else soft scores with a clear lead; else other."""
    each = docs.select(key).join(signals, key, "left").groupBy(key).agg(
        *[F.coalesce(F.sum(F.when((F.col("category") == c) & ~F.col("strong"), F.col("weight"))), F.lit(0.0)).alias(f"s{k}") for k, c in enumerate(categories)],
        F.min(F.when(F.col("strong"), F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category")))).alias("strong_at"),
    )
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(-k).alias("k")) for k in range(len(categories))])))
    each = each.withColumn("r", ranked)
    top, second = F.get("r", F.lit(0))["score"], F.get("r", F.lit(1))["score"]
    names = F.array(*[F.lit(c) for c in categories])
    clear = (top >= LEAST_SCORE) & (top - second >= LEAST_LEAD)
    kind = F.when(F.col("strong_at").isNotNull(), F.get(names, (F.col("strong_at") - 1).cast("int"))).when(clear, F.get(names, -F.get("r", F.lit(0))["k"])).otherwise("other")
    return each.select(key, kind.alias("doc_type"), F.when(F.col("strong_at").isNotNull(), F.lit(1.0)).when(clear, confidence(top, second)).otherwise(F.lit(0.0)).alias("confidence"))


def default_catalog(spark: SparkSession) -> DataFrame:
    """The usual routing rules as rows: (domain, kind keyword, signal or exclude, keyword, enabled)."""
    rows = [(d, kind, w, True) for d, words in DOMAINS for kind, ws in (("keyword", words), ("signal", PROCESS_WORDS), ("exclude", EXCLUDE_WORDS)) for w in ws.split("|")]
    return spark.createDataFrame(rows, CATALOG)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Routing rules from a JSON file of domains; empty codes, repeated codes and empty keyword lists raise ValueError."""
    d = spark.read.option("multiLine", True).json(path).select(F.explode("domains").alias("d")).select("d.*")
    if d.filter("code IS NULL OR trim(code) = '' OR size(keywords) = 0").count() or d.count() != d.select("code").distinct().count():
        raise ValueError("the catalog has an empty or repeated code, or a domain without keywords")
    kinds = {"keyword": "keywords", "signal": "process_signals", "exclude": "exclude_signals"}
    parts = [d.select(F.col("code").alias("domain"), F.lit(k).alias("kind"), F.explode(c).alias("keyword"), "enabled") for k, c in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def select_domains(catalog: DataFrame, codes: list[str] | None) -> list[str]:
    """The enabled domains, or those asked for in their order; unknown, disabled or repeated ones raise ValueError."""
    known = [r["domain"] for r in catalog.filter("enabled").select("domain").distinct().orderBy("domain").collect()]
    if codes is None:
        return known
    if len(set(codes)) != len(codes) or set(codes) - set(known):
        raise ValueError(f"unknown, disabled or repeated domains in {codes}")
    return list(codes)


def route_processes(clauses: DataFrame, catalog: DataFrame, key: str = "clause_id", text: str = "raw_text", codes: list[str] | None = None) -> DataFrame:
    """key, decision, domains, confidence of clauses by the catalog's words.

    The catalog is a small configuration; it becomes patterns, so that a clause is read once and never joined.
    """
    chosen = select_domains(catalog, codes)
    rules = catalog.filter("enabled").groupBy("domain", "kind").agg(F.collect_set("keyword").alias("w")).collect()
    words = lambda kind, domains: [w for r in rules if r["kind"] == kind and r["domain"] in domains for w in r["w"]]
    t = squash(F.col(text))
    has = lambda ws: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in sorted(set(ws))], F.lit(False))
    domains = F.array_compact(F.array(*[F.when(has(words("keyword", [d])), F.lit(d)) for d in chosen]))
    c = clauses.withColumn("domains", domains)
    signal, exclude = has(words("signal", chosen)), has(words("exclude", {r["domain"] for r in rules}))
    some = F.size("domains") > 0
    decision = F.when(is_blank(F.col(text)), "non_process").when(some & signal, "process").when(exclude, "non_process").when(some, "pending").otherwise("non_process")
    sure = F.when(is_blank(F.col(text)), 1.0).when(some & signal, 0.96).when(exclude, 0.98).when(some, 0.5).otherwise(0.95)
    c = c.withColumn("decision", decision).withColumn("confidence", sure)
    return c.select(key, "decision", F.when(F.col("decision") == "non_process", F.array().cast("array<string>")).otherwise(F.col("domains")).alias("domains"), "confidence")


def answer_date(question: Column, requested: Column, today: Column) -> Column:
    """struct(as_of, source): the requested day, the only day in the question, today; null if ambiguous or historical."""
    q = text_or_blank(question)
    iso = F.transform(F.regexp_extract_all(q, F.lit(ISO_DATE), F.lit(1)), lambda s: F.try_to_date(s, "y-M-d"))
    cn = F.transform(F.regexp_extract_all(q, F.lit(CN_DATE), F.lit(0)), lambda s: F.try_to_date(F.regexp_replace(F.regexp_replace(s, r"\s", ""), "[年月]", "-"), "y-M-d"))
    days = F.array_distinct(F.array_compact(F.concat(iso, cn)))
    unclear = (F.size(days) > 1) | F.rlike(q, F.lit(HISTORY))
    as_of = F.when(requested.isNotNull(), requested).when(F.size(days) == 1, F.get(days, F.lit(0))).when(unclear, None).otherwise(today)
    source = F.when(requested.isNotNull(), "request").when(F.size(days) == 1, "question").when(unclear, "ambiguous").otherwise("today")
    return F.struct(as_of.alias("as_of"), source.alias("source"))


def low_confidence_name(name: Column) -> Column:
    n = F.lower(text_or_blank(name))
    return (n == "") | F.rlike(n, F.lit(LOW_CONFIDENCE_NAME))


def display_name(name: Column, title: Column) -> Column:
    """The file's name, or if that says nothing the cleaned title of 3 to 180 characters."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(title), r"(?U)\s+", " "), r'[<>:"/\\|?*\x00-\x1f]', ""), r"^[. ]+|[. ]+$", "")
    named = F.when(F.lower(clean).endswith(".pdf"), clean).otherwise(F.concat(clean, F.lit(".pdf")))
    return F.when(low_confidence_name(strip(name)) & F.length(clean).between(3, 180), named).otherwise(strip(name))


def image_class(width: Column, height: Column, least: int = 100) -> Column:
    """icon, seal, chart or photo by size."""
    short, long = F.least(width, height), F.greatest(width, height)
    aspect = long / F.greatest(short, F.lit(1))
    return F.when((width < least) & (height < least), "icon").when(aspect > 5, "seal").when((short >= 300) & (aspect < 1.25), "chart").otherwise("photo")


def image_extension(content: Column) -> Column:
    head = F.hex(F.substr(content, F.lit(1), F.lit(12)))
    return F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8"), "jpg").when(head.startswith("52494646") & F.contains(head, F.lit("57454250")), "webp").when(head.startswith("474946383761") | head.startswith("474946383961"), "gif").otherwise("png")


def mojibake(text: Column) -> Column:
    """Latin-1 text that was UTF-8, put right where that leaves fewer replacement characters and makes sense."""
    back = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    marks = lambda c: F.regexp_count(c, F.lit("[ÃÂÐÑåäæçèé][\\x{80}-\\x{bf}]"))
    return F.when((marks(text) > 0) & ~F.contains(text, F.lit("�")), back).otherwise(text)
