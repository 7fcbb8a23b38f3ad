"""Ledgers, reviews and graphs, with events, orders, labels and places standing for items."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrid.operators import graphs as G
from docgrid.operators import ledger as L
from docgrid.operators import review as R

from .common import as_duck, made, table

NOW = "2024-01-20 12:00:00"
STATUS = {"signup": "pending", "error": "failed", "click": "succeeded", "view": "skipped", "purchase": "running"}


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _items(spark, sf_dir):
    """Events as items of the batch of their user."""
    kind = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("item_id"), F.col("user_id").alias("batch_id"), kind[F.col("event_type")].alias("status"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("heartbeat_at"),
        F.lit(None).cast("timestamp_ntz").alias("next_retry_at"), F.when(F.col("value") > 50, "transient").otherwise("permanent").alias("error_kind"), (F.col("event_id") % 4).alias("attempt_count"),
    )


_ITEMS = """i AS (SELECT event_id AS item_id, user_id AS batch_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'succeeded' WHEN 'view' THEN 'skipped' ELSE 'running' END AS status,
  CASE WHEN event_type = 'purchase' THEN ts END AS heartbeat_at, CASE WHEN value > 50 THEN 'transient' ELSE 'permanent' END AS error_kind, event_id % 4 AS attempt_count FROM events)"""


def batch_dedupe(spark, sf_dir):
    """Documents as files of a batch; those of one source were done before."""
    d = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.sha2("text", 256).alias("file_hash"), "source")
    done = d.filter("source = 'src1'").select("file_hash", F.col("path").alias("file_id"))
    return L.create_batch(d.filter("source <> 'src1'").drop("source"), done).select("path", "status", "reuse_file_id", "duplicate_of")


def ledger_eligible(spark, sf_dir):
    return _items(spark, sf_dir).filter(L.eligible(_now(), resume=True)).select("item_id", "status")


def ledger_transition(spark, sf_dir):
    i = _items(spark, sf_dir).filter("status IN ('failed', 'succeeded')").withColumn("ok", F.col("status") == "succeeded").withColumn("error", F.when(F.col("error_kind") == "transient", "HTTP 503").otherwise("bad file"))
    return L.after_attempt(i, _now()).select("item_id", "new_status", "new_attempt_count", "new_error_kind", F.date_format("new_retry_at", "yyyy-MM-dd HH:mm:ss").alias("new_retry_at"))


def batch_rollup(spark, sf_dir):
    return L.batch_summary(_items(spark, sf_dir))


def run_rollup(spark, sf_dir):
    i = _items(spark, sf_dir).withColumn("status", F.when(F.col("status") == "skipped", "needs_review").otherwise(F.col("status")))
    return L.run_summary(i, "batch_id")


def upsert_latest(spark, sf_dir):
    """Events of a user: the old half and the new half, the latest stays."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type").withColumn("version", F.struct("ts", "event_id"))
    out = L.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "version")
    return out.select("user_id", "event_id", "event_type")


def upsert_guarded(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.select("o_orderkey", F.lit("old").alias("v"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("review_status"))
    new = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("v"), F.lit("pending").alias("review_status")).unionByName(o.filter("o_orderkey % 5 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("new").alias("v"), F.lit("pending").alias("review_status")))
    return L.upsert_guarded(old, new, "o_orderkey")


def update_rows(spark, sf_dir):
    return L.update_where(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), {"c_acctbal": F.col("c_acctbal") * 2, "c_mktsegment": F.lower("c_mktsegment")}, F.col("c_acctbal") < 0)


def current_run(spark, sf_dir):
    """Orders of a customer as runs of a batch; one order becomes current."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("batch_id"), (F.col("o_orderstatus") == "O").alias("is_current"))
    return L.make_current(runs, "run_id", F.lit(7))


def cascade_reset(spark, sf_dir):
    """Orders and lines without those of the customers of one nation."""
    gone = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").filter("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    left = L.reset({"orders": (table(spark, sf_dir, "orders"), "o_orderkey"), "lineitem": (table(spark, sf_dir, "lineitem"), "l_orderkey")}, gone, "o_orderkey")
    return left["orders"].agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s")).select(F.lit("orders").alias("t"), "n", "s").unionByName(left["lineitem"].agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("s")).select(F.lit("lineitem").alias("t"), "n", "s"))


def empty_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    return L.empty_runs(runs, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id")))


def folder_reset_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    items = e.select(F.concat("user_id", F.lit("-"), F.col("event_id") % 7).alias("file_id"), "user_id", (F.col("event_id") % 5).alias("batch_id"), F.when(F.col("event_type") == "purchase", "running").otherwise("succeeded").alias("status"), F.col("ts").alias("heartbeat_at"))
    chosen = items.groupBy("file_id").agg(F.min("batch_id").alias("batch_id"))
    return L.folder_plan(chosen, items, _now())


def label_metrics(spark, sf_dir):
    """Quality and toxicity labels against a prediction from the text's marks."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    has = lambda c, v: F.when(c, F.lit(v))
    pairs = d.select(F.array_compact(F.array(has(~F.col("text").rlike(r"[*&$%#|!]{2}"), "good"), has(F.lower("text").rlike("idiot|stupid|scum"), "toxic"))).alias("predicted"), F.array_compact(F.array(has(F.col("quality") == 1, "good"), has(F.col("toxic") == 1, "toxic"))).alias("actual"))
    return R.label_metrics(pairs, ["good", "toxic", "none"])


def exact_match(spark, sf_dir):
    d = table(spark, sf_dir, "labels")
    return R.exact_match_rate(d.select(F.array(F.col("quality")).alias("predicted"), F.array(1 - F.col("toxic")).alias("actual")))


def quality_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 4 > 0, F.when(F.col("quality") == 1, "是").otherwise("No")).alias("text_ok"), F.when(F.col("doc_id") % 3 > 0, F.when(F.col("toxic") == 0, " YES ").otherwise("错误")).alias("tone_ok"))
    return R.quality_summary(rows, ["text_ok", "tone_ok"])


def error_code_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit(" "), "event_type", F.lit("，e"), F.col("event_id") % 3, F.lit("; x ")).alias("codes"))
    return R.error_codes(e, "codes")


def even_sample(spark, sf_dir):
    return R.even_sample(table(spark, sf_dir, "documents"), "source", ["doc_id"], 7).select("source", "doc_id")


def balanced_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("policy_id"), F.col("doc_id").alias("clause_id"), F.when(F.col("doc_id") % 3 == 0, "p").alias("parent_clause_id"), F.col("doc_id").alias("sequence_no"), F.col("text").alias("raw_text"))
    return R.balanced_sample(d, 20, (("en", "the"), ("parent", None), ("fr", "eau"), ("any", ".")))


def latest_annotation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit("/"), "role").alias("candidate_id"), F.when((F.col("turn") == 0) & (F.col("role") == "user"), "added").otherwise("approved").alias("decision"), F.col("turn").alias("created_at"), F.col("turn").alias("annotation_id"))
    return R.latest_annotations(c)


def graph_candidates(spark, sf_dir):
    """Nations and regions as entities, their belonging as relations."""
    n = table(spark, sf_dir, "nation")
    e = n.select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("entity_id"), F.col("r_name").alias("name")))
    r = n.select(F.concat(F.lit("x"), "n_nationkey").alias("relation_id"), F.lit("part_of").alias("relation_type"), F.concat(F.lit("n"), "n_nationkey").alias("subject_id"), F.concat(F.lit("r"), "n_regionkey").alias("object_id"))
    return G.graph_candidates(e, r)


def workflow_graph_edges(spark, sf_dir):
    """Customers as nodes, orders as edges to the customer of the next number; events decide on customers."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("candidate_id"), F.lit("entity").alias("candidate_type"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("subject_id"), F.lit(None).cast("string").alias("object_id"), F.when(F.col("c_acctbal") > 0, "approved").otherwise("pending").alias("review_status"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("candidate_id"), F.lit("relation").alias("candidate_type"), F.lit("next").alias("name"), F.concat(F.lit("c"), "o_custkey").alias("subject_id"), F.concat(F.lit("c"), F.col("o_custkey") + 1).alias("object_id"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("auto_approved").alias("review_status"))
    a = table(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')").select(F.concat(F.lit("c"), "user_id").alias("candidate_id"), F.when(F.col("event_type") == "error", "rejected").otherwise("approved").alias("decision"), F.lit("").alias("label"), F.col("ts").alias("created_at"), F.col("event_id").alias("annotation_id"))
    return G.workflow_graph(c.unionByName(o), a)[1]


def run_progress(spark, sf_dir):
    """Orders of a customer as the items of a run: what isn't open is done a day after it began."""
    o = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    return L.progress(o, "o_custkey", F.col("o_orderstatus") != "O", F.col("at"), F.expr("at + INTERVAL 1 DAY"))


#: Customers as clauses and as what a model says of them, with each kind of fault.
ASSERTIONS = """SELECT CASE WHEN c_custkey % 8 = 5 THEN 'none' || c_custkey ELSE 'c' || c_custkey END AS clause_id, CASE WHEN c_custkey % 8 = 3 THEN 'wish' ELSE 'action' END AS kind, CASE WHEN c_custkey % 8 = 7 THEN 'maybe' ELSE 'required' END AS modality,
  CASE WHEN c_custkey % 8 = 6 THEN '校长' ELSE '申请人' END AS subject, '提交' AS predicate, c_mktsegment AS object,
  CASE c_custkey % 8 WHEN 2 THEN '可以' WHEN 4 THEN '' ELSE '应当提交' || c_mktsegment END AS evidence, CASE WHEN c_custkey % 8 = 1 THEN 99 ELSE length(c_name) + 3 END AS start, length(c_name) + 7 + length(c_mktsegment) AS end FROM {customer}"""
CLAUSE_TEXTS = "SELECT 'c' || c_custkey AS clause_id, c_name || '申请人应当提交' || c_mktsegment || '，可以委托，不可以转让。' AS raw_text FROM {customer}"


def assertion_checks(spark, sf_dir):
    said = made(spark, sf_dir, ASSERTIONS)
    out = G.check_assertions(said.unionAll(said), made(spark, sf_dir, CLAUSE_TEXTS))
    return out.select("clause_id", "kind", "evidence", "error", F.when(F.col("error").isNull(), F.col("start")).cast("int").alias("start"))


QUERIES = {
    f.__name__: f
    for f in (
        batch_dedupe, ledger_eligible, ledger_transition, batch_rollup, run_rollup, upsert_latest, upsert_guarded, update_rows, current_run, cascade_reset, empty_runs, folder_reset_plan,
        label_metrics, exact_match, quality_summary, error_code_counts, even_sample, balanced_sample, latest_annotation, graph_candidates, workflow_graph_edges, assertion_checks, run_progress,
    )
}
_METRIC = "coalesce(round({} / nullif({}, 0)::DOUBLE, 6), 0.0::DOUBLE)"
SQL = {
    "batch_dedupe": """WITH d AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, sha256(text) AS h, source FROM documents),
r AS (SELECT h, min(path) AS reuse FROM d WHERE source = 'src1' GROUP BY h),
f AS (SELECT path, reuse, min(path) OVER (PARTITION BY h) AS first FROM d LEFT JOIN r USING (h) WHERE source <> 'src1')
SELECT path, CASE WHEN reuse IS NOT NULL OR first <> path THEN 'skipped' ELSE 'pending' END AS status, reuse AS reuse_file_id, CASE WHEN reuse IS NULL AND first <> path THEN first END AS duplicate_of FROM f""",
    "ledger_eligible": f"""WITH {_ITEMS} SELECT item_id, status FROM i WHERE status = 'pending' OR (status = 'running' AND epoch(TIMESTAMP '{NOW}') - floor(epoch(heartbeat_at)) > 1800)
OR (status = 'failed' AND error_kind = 'transient' AND attempt_count < 3)""",
    "ledger_transition": f"""WITH {_ITEMS}, o AS (SELECT *, status = 'succeeded' AS ok, error_kind = 'transient' AS tr, attempt_count + 1 AS n FROM i WHERE status IN ('failed', 'succeeded'))
SELECT item_id, CASE WHEN ok THEN 'succeeded' WHEN tr AND n < 3 THEN 'retry_wait' ELSE 'failed' END AS new_status, n AS new_attempt_count, CASE WHEN NOT ok THEN CASE WHEN tr THEN 'transient' ELSE 'permanent' END END AS new_error_kind,
CASE WHEN NOT ok AND tr AND n < 3 THEN strftime(TIMESTAMP '{NOW}' + to_seconds(CASE n WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END), '%Y-%m-%d %H:%M:%S') END AS new_retry_at FROM o""",
    "batch_rollup": f"""WITH {_ITEMS}, g AS (SELECT batch_id, count(*) FILTER (status = 'succeeded') AS succeeded_count, count(*) FILTER (status = 'skipped') AS skipped_count,
count(*) FILTER (status = 'failed' AND error_kind = 'transient') AS retryable_failed_count, count(*) FILTER (status = 'failed' AND error_kind = 'permanent') AS permanent_failed_count,
bool_and(status IN ('succeeded', 'skipped', 'failed')) AS e, bool_or(status = 'failed') AS f, bool_or(status = 'running') AS r FROM i GROUP BY 1)
SELECT batch_id, succeeded_count, skipped_count, retryable_failed_count, permanent_failed_count,
CASE WHEN e THEN CASE WHEN NOT f THEN 'succeeded' WHEN succeeded_count + skipped_count > 0 THEN 'partial_failed' ELSE 'failed' END WHEN r THEN 'running' ELSE 'pending' END AS status FROM g""",
    "run_rollup": f"""WITH {_ITEMS}, g AS (SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS needs_review FROM i GROUP BY 1)
SELECT *, CASE WHEN succeeded + failed + needs_review < total THEN 'running' WHEN failed > 0 THEN 'partial_failed' ELSE 'succeeded' END AS status FROM g""",
    "upsert_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "upsert_guarded": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS v, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'approved' END AS review_status FROM orders
UNION ALL SELECT -o_orderkey - 1, 'new', 'pending' FROM orders WHERE o_orderkey % 5 = 0""",
    "update_rows": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "current_run": "SELECT o_orderkey AS run_id, o_custkey AS batch_id, CASE WHEN o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7) THEN o_orderkey = 7 ELSE o_orderstatus = 'O' END AS is_current FROM orders",
    "cascade_reset": """WITH g AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)
SELECT 'orders' AS t, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderkey NOT IN (FROM g) UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (FROM g)""",
    "empty_runs": "SELECT c_custkey AS run_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "folder_reset_plan": f"""WITH i AS (SELECT user_id || '-' || event_id % 7 AS file_id, user_id, event_id % 5 AS batch_id, event_type = 'purchase' AS running, epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) > 1800 AS old FROM events),
c AS (SELECT file_id, min(batch_id) AS mine FROM i GROUP BY 1)
SELECT file_id, CASE WHEN bool_or(running AND NOT old) THEN 'busy' WHEN bool_or(running AND old) THEN 'stale' WHEN bool_or(batch_id <> mine) THEN 'shared' ELSE 'free' END AS plan FROM c JOIN i USING (file_id) GROUP BY 1""",
    "label_metrics": f"""WITH d AS (SELECT NOT regexp_matches(text, '[*&$%#|!]{{2}}') AS pg, regexp_matches(lower(text), 'idiot|stupid|scum') AS pt, quality = 1 AS ag, toxic = 1 AS at_ FROM labels JOIN documents USING (doc_id)),
u AS (SELECT 'good' AS label, pg AS p, ag AS a FROM d UNION ALL SELECT 'toxic', pt, at_ FROM d UNION ALL SELECT 'none', false, false FROM d),
g AS (SELECT label, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p) AS said, count(*) FILTER (a) AS support FROM u GROUP BY 1)
SELECT label, {_METRIC.format("tp", "said")} AS precision, {_METRIC.format("tp", "support")} AS recall, support FROM g""",
    "exact_match": "SELECT count(*) AS n, round(avg(CASE WHEN quality = 1 - toxic THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS exact_match_rate FROM labels",
    "quality_summary": """WITH r AS (SELECT CASE WHEN doc_id % 4 > 0 THEN quality = 1 END AS t, CASE WHEN doc_id % 3 > 0 THEN toxic = 0 END AS o FROM labels)
SELECT count(*) FILTER (t IS NOT NULL OR o IS NOT NULL) AS reviewed, count(*) FILTER (t AND o) AS fully_correct, count(*) FILTER (NOT t) AS text_ok_errors, count(*) FILTER (NOT o) AS tone_ok_errors FROM r""",
    "error_code_counts": "SELECT code, count(*) AS n FROM (SELECT unnest([upper(event_type), 'E' || event_id % 3, 'X']) AS code FROM events) GROUP BY 1",
    "even_sample": """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM r WHERE n <= 7 OR i IN (SELECT CAST(round_even(p * (n - 1) / 6.0::DOUBLE, 0) AS BIGINT) FROM range(7) x(p))""",
    "latest_annotation": """WITH c AS (SELECT conv_id || '/' || role AS candidate_id, CASE WHEN turn = 0 AND role = 'user' THEN 'added' ELSE 'approved' END AS decision, turn AS created_at, turn AS annotation_id FROM conversations)
(SELECT * FROM c WHERE decision <> 'added' QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY created_at DESC, annotation_id DESC) = 1) UNION ALL SELECT * FROM c WHERE decision = 'added'""",
    "graph_candidates": """WITH e AS (SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region)
SELECT id AS candidate_id, 'entity' AS candidate_type, name, NULL::VARCHAR AS subject_name, NULL::VARCHAR AS object_name FROM e
UNION ALL SELECT 'x' || n_nationkey, 'relation', 'part_of', s.name, o.name FROM nation LEFT JOIN e s ON s.id = 'n' || n_nationkey LEFT JOIN e o ON o.id = 'r' || n_regionkey""",
    "workflow_graph_edges": """WITH a AS (SELECT user_id AS k, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('error', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
n AS (SELECT c_custkey AS k FROM customer LEFT JOIN a ON k = c_custkey WHERE coalesce(ok, c_acctbal > 0))
SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS subject_id, 'c' || (o_custkey + 1) AS object_id FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (FROM n) AND o_custkey + 1 IN (FROM n)""",
    "run_progress": """WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'O') AS done, count(*) AS total, min(epoch(o_orderdate)) AS a, max(epoch(o_orderdate) + 86400) FILTER (o_orderstatus <> 'O') AS b FROM orders GROUP BY 1),
m AS (SELECT *, coalesce((b - a) / greatest(done, 1), 0.0::DOUBLE)::DOUBLE AS v FROM g) SELECT o_custkey, done, total, round(v, 1) AS average_seconds, CAST(round_even((total - done) * v, 0) AS BIGINT) AS remaining_seconds FROM m""",
    "assertion_checks": f"""SELECT clause_id, kind, evidence, CASE WHEN clause_id LIKE 'none%' THEN 'unknown clause' WHEN kind = 'wish' THEN 'unknown kind' WHEN modality = 'maybe' THEN 'unknown modality' WHEN evidence = '' THEN 'no evidence'
WHEN evidence = '可以' THEN 'evidence isn''t in the clause once' WHEN subject = '校长' THEN 'unsupported subject' END AS error,
CASE WHEN clause_id NOT LIKE 'none%' AND kind = 'action' AND modality = 'required' AND evidence NOT IN ('', '可以') AND subject = '申请人' THEN CAST("end" - 4 - length(object) AS INTEGER) END AS start FROM ({as_duck(ASSERTIONS)})""",
}
