"""Sources, streaming, the warehouse and the session, on small literal inputs."""

import io
import json
import re
import time
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgrid.functions import rules
from docgrid.operators import extraction, graphs, hierarchy, ledger, metadata, providers, retrieval, review, sections, tables, vectors
from docgrid.plans import tables as plans
from docgrid.session import Session, Warehouse
from docgrid.sources import documents, files
from docgrid.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx() -> bytes:
    body = "<w:p><w:r><w:t>第一条 目的</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a&lt;b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p/>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/A.docx").write_bytes(docx())
    (tmp_path / "~$A.docx").write_bytes(b"lock")
    (tmp_path / "b.txt").write_bytes(b"no")
    (tmp_path / "c.PDF").write_bytes(b"%PDF")
    found = files.scan(spark, str(tmp_path))
    assert {r["file_name"] for r in found.collect()} == {"A.docx", "c.PDF"}
    out = {r["file_name"]: r for r in documents.parse_files(found, remote=lambda data: ([{"ordinal": 0, "type": "text", "page_num": 1, "content": data.decode(), "table_html": ""}], {})).collect()}
    assert [b["content"] for b in out["A.docx"]["blocks"]] == ["第一条 目的", "<table><tr><td>a&lt;b</td><td></td></tr></table>"]
    assert out["c.PDF"]["blocks"][0]["content"] == "%PDF" and out["c.PDF"]["error"] is None


def test_csv_with_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "x",\nline two'), ("2", None)], "a string, b string")
    files.write_csv(df, str(tmp_path / "out"), ["b", "a"])
    back = files.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["b", "a"] and {tuple(r) for r in back.collect()} == {('say "x",\nline two', "1"), (None, "2")}


def test_content_lists(spark, tmp_path):
    items = [{"type": "text", "text": "Title", "text_level": 1, "page_idx": 0}, {"type": "table", "table_body": "<table></table>", "table_caption": ["X010102", " "], "page_idx": 0}, {"type": "chart", "img_path": "a.png", "page_idx": 1}]
    (tmp_path / "content_list.json").write_text(json.dumps(items))
    got = files.read_content_lists(spark, str(tmp_path / "content_list.json")).orderBy("ordinal").collect()
    assert [(r["type"], r["content"], r["caption"], r["page_num"]) for r in got] == [("text", "Title", "", 0), ("table", "<table></table>", "X010102", 0), ("image", "a.png", "", 1)]
    assert len({r["block_id"] for r in got}) == 3


def test_catalog_file(spark, tmp_path):
    good = {"domains": [{"code": "x", "enabled": True, "keywords": ["买"], "process_signals": ["交"], "exclude_signals": []}, {"code": "y", "enabled": False, "keywords": ["卖"], "process_signals": [], "exclude_signals": []}]}
    (tmp_path / "c.json").write_text(json.dumps(good))
    c = rules.load_catalog(spark, str(tmp_path / "c.json"))
    assert rules.select_domains(c, None) == ["x"]
    with pytest.raises(ValueError):
        rules.select_domains(c, ["y"])
    got = rules.route_processes(spark.createDataFrame([(1, "买 后 交"), (2, "卖")], "clause_id int, raw_text string"), c).orderBy("clause_id").collect()
    assert [r["decision"] for r in got] == ["process", "non_process"]
    good["domains"][1]["code"] = "x"
    (tmp_path / "d.json").write_text(json.dumps(good))
    with pytest.raises(ValueError):
        rules.load_catalog(spark, str(tmp_path / "d.json"))


def test_ingest_takes_each_content_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a").write_bytes(b"one")
    (src / "b").write_bytes(b"one")
    process = lambda df: df.select("path", "file_hash", F.length("content").alias("size"))
    assert ingest.ingest(spark, str(src), str(tmp_path / "w"), process) == 1
    (src / "c").write_bytes(b"two")
    (src / "d").write_bytes(b"one")
    assert ingest.ingest(spark, str(src), str(tmp_path / "w"), process) == 2
    assert ingest.ingest(spark, str(src), str(tmp_path / "w"), process) == 2


def test_filters_refuse(spark):
    df = spark.createDataFrame([(1, "a%b", 2.0), (2, "axb", 3.0)], "_row_id int, name string, n double")
    pick = lambda f: [r["_row_id"] for r in df.filter(tables.compile_filters(df, f)).collect()]
    assert pick([{"column": "name", "operator": "contains", "value": "A%"}]) == [1]
    assert pick('[{"column": "n", "operator": "gte", "value": 3}]') == [2]
    for bad in ("{}", [{"column": "_row_id", "operator": "equals", "value": 1}], [{"column": "name", "operator": "gte", "value": 1}], [{"column": "n", "operator": "lte", "value": True}], [{"column": "n", "operator": "like", "value": 1}], [{"column": "n"}]):
        with pytest.raises(ValueError):
            tables.compile_filters(df, bad)


def test_negation_and_partial_abolition(spark):
    def said(text):
        d = spark.createDataFrame([(1, text)], "clause_id int, raw_text string")
        return [r["target_title"] for r in extraction.abolition_candidates(d).orderBy("ordinal").collect()]

    assert said("《甲办法》、《乙办法》和《丙办法》同时废止。") == ["甲办法", "乙办法", "丙办法"]
    assert said("《甲办法》不予废止。") == [] and said("不得废止《甲办法》") == [] and said("《甲办法》第二条废止") == []
    assert said("根据《上位法》，《甲办法》即废止") == ["甲办法"] and said("《甲办法》即行废止") == []
    assert said("《甲办法》继续执行。废止") == [] and said("《甲办法》 废止") == ["甲办法"] and said("《甲办法》（1号）第三条废止") == []
    assert said(f"《甲办法》{'，' * 24}废止") == ["甲办法"] and said(f"《甲办法》{'，' * 25}废止") == []


def test_spans_and_types(spark):
    d = spark.createDataFrame([("abcabc", "abc"), ("abcd", "bc"), ("x", "y")], "s string, e string")
    assert [r[0] for r in d.select(graphs.evidence_span(F.col("s"), F.col("e"))).collect()] == [None, 1, None]


def test_chunks_of_odd_texts(spark):
    d = spark.createDataFrame([(1, "a" * 1000), (2, ""), (3, None), (4, "\n\n x \r\ny")], "doc_id int, text string")
    got = {}
    for r in sections.chunk_documents(d).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert [len(t) for t in got[1]] == [512, 512, 76] and got[4] == ["x\ny"] and set(got) == {1, 4}


def test_even_sample_rounds_half_to_even(spark):
    d = spark.range(6).selectExpr("'g' g", "id")
    assert [r["id"] for r in review.even_sample(d, "g", ["id"], 3).orderBy("id").collect()] == [0, 2, 5]


def test_ledger_retries(spark):
    rows = [(1, 0, False, "HTTP 503"), (2, 2, False, "Timeout"), (3, 0, False, "bad file"), (4, 1, True, None)]
    d = spark.createDataFrame(rows, "id int, attempt_count int, ok boolean, error string")
    got = ledger.after_attempt(d, F.lit("2024-01-01 00:00:00").cast("timestamp")).orderBy("id").collect()
    assert [r["new_status"] for r in got] == ["retry_wait", "failed", "failed", "succeeded"]
    assert [r["new_error_kind"] for r in got] == ["transient", "transient", "permanent", None]


def test_numbered_clauses_without_formal_levels(spark):
    lines = [("p", 1, 0, k, t) for k, t in enumerate(("1. 首", "（1）细", "2. 次", "3.14 不是编号"))]
    got = hierarchy.build_clauses(spark.createDataFrame(lines, "policy_id string, page int, ordinal int, line_no int, line string")).orderBy("sequence_no").collect()
    assert [(r["parent_no"], r["item_no"]) for r in got] == [(None, "1."), (1, "（1）"), (None, "2.")] and got[2]["raw_text"].endswith("3.14 不是编号")


def test_bm25_counts_query_terms_twice(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(("red fox", "blue fox", "green bird", "grey wolf", "old owl"))], "doc_id int, text string")
    ask = lambda q: {r["doc_id"]: r["bm25_score"] for r in retrieval.bm25(docs, spark.createDataFrame([(q,)], "query_text string")).collect()}
    once, twice = ask("red"), ask("red red")
    assert set(once) == {0} and twice[0] == pytest.approx(2 * once[0], abs=1e-5)


@pytest.fixture()
def session(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    clauses = [("c1", "p1", None, "差旅 住宿费 标准 hotel", 1, "article", True), ("c2", "p1", "c1", "住宿费 不超过 500 元", 2, "item", True), ("c3", "p2", None, "采购 合同", 1, "article", True), ("c4", "p2", None, "旧 住宿费", 2, "article", False)]
    w.write("clauses", spark.createDataFrame(clauses, "clause_id string, policy_id string, parent_clause_id string, search_text string, sequence_no int, level string, is_active boolean"))
    policies = [("p1", "差旅办法", "current", "2020-01-01", None, "f", "succeeded"), ("p2", "采购办法", "invalid", "2010-01-01", "2015-01-01", "g", "succeeded"), ("p3", "", "current", None, None, None, "pending")]
    p = spark.createDataFrame(policies, "policy_id string, title string, validity_status string, effective_date string, expiry_date string, family_id string, structure_status string")
    w.write("policies", p.withColumn("effective_date", F.col("effective_date").cast("date")).withColumn("expiry_date", F.col("expiry_date").cast("date")))
    return Session(w)


def test_session(session, spark):
    assert [r["clause_id"] for r in session.search("住宿费 不超过").collect()][0] == "c2"
    assert {r["clause_id"] for r in session.search("采购 住宿费", as_of="2021-01-01", today="2024-01-01").collect()} <= {"c1", "c2"}
    assert [r["policy_id"] for r in session.list_policies().orderBy("title").collect()] == ["p1", "p2"]
    assert [c["clause_id"] for c in session.policy_detail("p1").first()["clauses"]] == ["c1", "c2"]
    assert session.context(session.search("住宿费 不超过", 1)).first()["related"] == ["c1"]
    said = session.answer("2021-01-01 住宿费 标准", today="2024-01-01")
    assert said["as_of"] == "2021-01-01" and said["evidence"] and said["conclusion"] == "undetermined"
    assert session.answer("以前的住宿费", today="2024-01-01")["needs_clarification"]
    with pytest.raises(ValueError):
        session.search(" ")


def test_conversations(session, spark):
    from docgrid.functions.ids import owner_hash

    row = spark.range(1).select(F.lit("v1").alias("conversation_id"), owner_hash(F.lit("me")).alias("owner_hash"), F.lit("").alias("title"), F.current_timestamp().alias("updated_at"))
    session.w.write("conversations", row)
    session.save_message("me", "v1", "m1", "问题一", "答", "2024-01-01 00:00:00")
    session.save_message("me", "v1", "m2", "问题二", "答", "2024-01-02 00:00:00")
    assert session.list_conversations("me").first()["title"] == "问题一" and session.list_conversations("you").count() == 0
    with pytest.raises(ValueError):
        session.save_message("you", "v1", "m3", "x", "y", "2024-01-01 00:00:00")
    session.rate("me", "m1", "up", "2024-01-03 00:00:00")
    session.rate("me", "m1", "down", "2024-01-04 00:00:00")
    assert [r["rating"] for r in session.w.read("feedback").collect()] == ["down"]
    session.delete_conversation("you", "v1")
    assert session.list_conversations("me").count() == 1
    session.delete_conversation("me", "v1")
    assert session.list_conversations("me").count() == 0 and session.w.read("messages").count() == 0


def test_snapshots(session, spark):
    first = session.w.snapshot("policies")
    session.w.update("policies", {"title": F.lit("新")}, F.col("policy_id") == "p1")
    with pytest.raises(ValueError):
        session.w.write("policies", spark.range(1), expected=first)
    assert {r["title"] for r in session.w.read("policies").collect()} == {"新", "采购办法", ""}


def test_table_pages(session, spark):
    cells = [("f", "b", r, c, k, t, v) for r in range(5) for c, (k, t, v) in enumerate((("name", "TEXT", f"n{r}"), ("sum", "INTEGER", str(r * 10))))]
    session.w.write("cells", spark.createDataFrame(cells, "file_id string, block_id string, row_idx int, col_idx int, key string, data_type string, value string"))
    got = session.table_data("f", "b", [{"column": "sum", "operator": "gte", "value": 10}], 2, 1).collect()
    assert [(r["name"], r["sum"], r["has_more"]) for r in got] == [("n2", 20, True), ("n3", 30, True)]


def test_providers(spark):
    from docgrid.operators import providers

    c = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "z", 3)], "clause_id string, search_text string, rank int")
    got = providers.semantic_rerank(c, "q", lambda q, texts: [0.1, 0.9, 0.9]).collect()
    assert [r["clause_id"] for r in got] == ["b", "c", "a"] and got[0]["reranked"]
    for bad in (lambda q, t: [1.0], lambda q, t: [2.0] * 3, lambda q, t: 1 / 0):
        assert [(r["clause_id"], r["reranked"]) for r in providers.semantic_rerank(c, "q", bad).collect()] == [("a", False), ("b", False), ("c", False)]
    v = providers.embed(c, "clause_id", "search_text", lambda texts: [[3.0, 4.0]] * len(texts), 2).first()["embedding"]
    assert v == pytest.approx([0.6, 0.8])
    h = {r["clause_id"]: r["embedding"] for r in providers.hashed_vectors(c.union(spark.createDataFrame([("d", "x", 4), ("e", "", 5)], c.schema)), "clause_id", "search_text", 8).collect()}
    assert h["a"] == h["d"] and sum(h["e"]) == 0 and sum(x * x for x in h["a"]) == pytest.approx(1)


def test_products_of_files(spark):
    from docgrid.operators import process

    block = lambda k, text, kind="text": {"ordinal": k, "type": kind, "page_num": 1, "content": text, "table_html": text if kind == "table" else ""}
    grid = "<table><tr><th>序号</th><th>名称</th><th>金额</th></tr>" + "".join(f"<tr><td>{k}</td><td>x{k}</td><td>{k}00</td></tr>" for k in range(6)) + "</table>"
    form = "<table><tr><td>签名</td><td></td></tr><tr><td>日期</td><td></td></tr></table>"
    rows = [
        ("f1", "办法.docx", [block(0, "采购管理办法"), block(1, "校发〔2023〕7号"), block(2, "第一条 原《旧办法》同时废止。\n第二条 二。\n第三条 通知及办法。"), block(3, grid, "table"), block(4, form, "table")], {}, None),
        ("f2", "x.doc", [], {}, "the document is empty"),
    ]
    parsed = spark.createDataFrame(rows, "file_id string, file_name string, blocks array<struct<ordinal:int,type:string,page_num:int,content:string,table_html:string>>, metadata map<string,string>, error string")
    out = process.process_documents(parsed)
    assert out["types"].first()["doc_type"] == "policy_regulation"
    about = {r["file_id"]: r for r in out["metadata"].collect()}
    assert about["f1"]["title"] == "办法" and about["f1"]["doc_number"] == "校发〔2023〕7号"
    assert [r["level"] for r in out["clauses"].orderBy("sequence_no").collect()] == ["preamble", "article", "article", "article"]
    assert [r["target_title"] for r in out["relations"].collect()] == ["旧办法"]
    assert {r["category"] for r in out["tables"].collect()} == {"data_table", "form"} and out["cells"].count() == 18
    assert out["chunks"].count() == 3 and out["lineage"].count() == 5 and out["errors"].count() == 1


def test_relations_and_reviews(spark):
    from docgrid.operators import process

    clauses = spark.createDataFrame([("c1", "p1", "2019年印发的《旧办法》同时废止。"), ("c2", "p1", "《另一办法》废止。")], "clause_id string, policy_id string, raw_text string")
    docs = spark.createDataFrame([("p1", "新办法", "", None), ("p2", "旧办法", "校发〔2019〕1号", None), ("p3", "旧办法", "校发〔2020〕1号", None)], "policy_id string, title string, doc_number string, issue_date string").withColumn("issue_date", F.col("issue_date").cast("date"))
    r = process.abolition_relations(clauses, docs)
    assert {x["target_title"]: x["target_policy_id"] for x in r.collect()} == {"旧办法": "p2", "另一办法": None}
    later = docs.union(spark.createDataFrame([("p9", "另一办法", "", None)], docs.schema))
    assert [x["target_policy_id"] for x in process.reconcile(r, later, "p9").collect()] == ["p9"]
    ids_ = {x["target_title"]: x["relation_id"] for x in r.collect()}
    say = spark.createDataFrame([(ids_["旧办法"], "approved", None, None), (ids_["另一办法"], "approved", None, None)], "relation_id string, decision string, target_policy_id string, effective_date date")
    assert {x["target_title"]: x["review_status"] for x in process.review_relations(r, say).collect()} == {"旧办法": "approved", "另一办法": "pending"}


def test_run_items_and_report(spark):
    from docgrid.operators import process

    items = spark.createDataFrame([(1, "pending", 0, None), (2, "succeeded", 1, None), (3, "pending", 0, None)], "item_id int, status string, attempt_count int, error_kind string")
    items = items.withColumn("next_retry_at", F.lit(None).cast("timestamp")).withColumn("heartbeat_at", F.lit(None).cast("timestamp"))
    work = lambda df: df.select("item_id", (F.col("item_id") == 1).alias("ok"), F.when(F.col("item_id") == 3, "HTTP 500").alias("error"))
    got = {r["item_id"]: r for r in process.run_items(items, work, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()}
    assert [got[k]["status"] for k in (1, 2, 3)] == ["succeeded", "succeeded", "retry_wait"] and got[3]["attempt_count"] == 1
    rows = spark.createDataFrame([("是", "e1,E2"), ("no", "e1")], "ok string, codes string")
    text = process.report(review.quality_summary(rows, ["ok"]), review.error_codes(rows, "codes"))
    assert "| E1 | 2 |" in text and "| reviewed | 2 |" in text
    d = spark.createDataFrame([("a", "corrected", "", ""), ("a", "approved", "", "no"), ("b", "approved", "", "")], "candidate_id string, decision string, label string, evidence_text string")
    c = spark.createDataFrame([("a", "原文")], "candidate_id string, raw_text string")
    assert {r["error"] for r in process.annotate(c, d).collect()} == {"a correction needs a label", "evidence isn't in the clause", "unknown candidate"}


def test_artifacts(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("r/other.md", "no")
        z.writestr("r/full.md", "标题")
        z.writestr("r/x_content_list.json", "[]")
        z.writestr("r/images/a.PNG", b"x")
    f = spark.createDataFrame([("a", bytearray(out.getvalue())), ("b", bytearray(b"junk"))], "file_id string, content binary")
    got = {r["file_id"]: r for r in documents.read_artifacts(f).collect()}
    assert got["a"]["markdown"] == "标题" and got["a"]["content_list"] == "[]" and got["a"]["images"] == ["r/images/a.PNG"]
    assert got["b"]["error"] == "not a ZIP archive"


def test_mojibake_and_acceptance(spark):
    d = spark.createDataFrame([("Ã©tÃ©",), ("été",), ("plain",), ("采购",)], "t string")
    assert [r[0] for r in d.select(rules.mojibake(F.col("t"))).collect()] == ["été", "été", "plain", "采购"]
    s = spark.createDataFrame([("approved",), ("rejected",), ("corrected",), ("pending",)], "s string")
    assert tuple(review.acceptance(s, F.col("s")).first()) == (3, 2, pytest.approx(0.666667))


def test_machine_rows_give_way(spark):
    old = spark.createDataFrame([(1, "machine"), (2, "approved")], "id int, status string")
    new = spark.createDataFrame([(3, "machine")], "id int, status string")
    assert {r["id"] for r in ledger.replace_machine_rows(old, new, ("approved",)).collect()} == {2, 3}
    e = spark.createDataFrame([("t", "n", 0.5, 1), ("t", "n", 0.9, 2), ("t", "n", 0.9, 3)], "entity_type string, name string, confidence double, ordinal int")
    assert graphs.best_entities(e).first()["ordinal"] == 2
    a = spark.createDataFrame([("c1", "machine_extracted"), ("c2", "rejected")], "clause_id string, status string")
    assert graphs.usable(a).count() == 1 and graphs.visible_context(a, a.filter("clause_id = 'c2'")).first()["clause_id"] == "c2"


def pdf_file(pages, packed=True):
    """A small PDF file out of content streams."""
    import zlib

    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    parts = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /Resources << /Font << /F1 3 0 R >> >> >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    out = b"%PDF-1.4\n" + b"".join(f"{k} 0 obj\n{t}\nendobj\n".encode() for k, t in enumerate(parts, 1))
    for i, t in enumerate(pages):
        data = zlib.compress(t.encode("cp1252")) if packed else t.encode("cp1252")
        out += f"{4 + 2 * i} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * i} 0 R >>\nendobj\n{5 + 2 * i} 0 obj\n<< {'/Filter /FlateDecode' if packed else ''} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_texts(spark):
    from docgrid.sources import documents, pdf

    pages = ["BT /F1 12 Tf 72 700 Td (Hello \\(world\\)) Tj 0 -14 Td [(Se) -20 (cond) -300 (line)] TJ ET", "", "BT /F1 9 Tf (\\311t\\351) Tj T* <4142> Tj ET"]
    for packed in (True, False):
        blocks, meta = pdf.parse_pdf(pdf_file(pages, packed))
        assert [(b["page_num"], b["content"]) for b in blocks] == [(0, "Hello (world)\nSecond line"), (2, "Été\nAB")] and meta == {"pages": "3"}
    assert pdf.character_map(b"1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange") == {1: "中", 16: "a", 17: "b", 18: "c"}
    rows = [("f1", "a.pdf", pdf_file(pages)), ("f2", "b.pdf", b"junk"), ("f3", "c.pdf", pdf_file([""]))]
    got = {r["file_id"]: r for r in documents.parse_files(spark.createDataFrame(rows, "file_id string, file_name string, content binary"), documents.read_pdf).collect()}
    assert len(got["f1"]["blocks"]) == 2 and got["f2"]["error"] == "not a PDF file" and got["f3"]["error"] == "the document is empty"


def test_polled_parser():
    from docgrid.sources import documents

    said, waited = ["queued", "running", "done"], []
    parse = documents.polled(lambda data: "t1", lambda task: said.pop(0), lambda task: ([{"content": task}], {}), wait=waited.append)
    assert parse(b"x") == ([{"content": "t1"}], {}) and waited == [2.0, 2.0]
    late = documents.polled(lambda data: "t", lambda task: "running", lambda task: ([], {}), pages=lambda data: 30, every=30.0, wait=waited.append)
    for bad in (late, documents.polled(lambda data: "t", lambda task: "failed", lambda task: ([], {}))):
        with pytest.raises(ValueError):
            bad(b"x")
    assert len(waited) == 2 + 3


def test_outputs_with_rules(spark):
    """Rules' results stand beside the model's: the surest mention stays, citations go first, doubts are listed."""
    from docgrid.operators import outputs

    clauses = spark.createDataFrame([("c1", "依据《会计法》，由财务处审核。")], "clause_id string, raw_text string")
    e = spark.createDataFrame([("c1", 0, "部门", "财务处", "由财务处", None, "0.5"), ("c1", 1, "步骤", "审核", "审核", None, "0.9"), ("c1", 2, "?", "x", "x", None, "1")], "clause_id string, position int, type string, name string, raw_text string, evidence string, confidence string")
    r = spark.createDataFrame([("c1", 0, "引用", None, None, "《会计法》", None, "0.9"), ("c1", 1, "performed_by", 1, 0, "", "由财务处审核", "0.9"), ("c1", 2, "performed_by", 1, 7, "", "审核", "0.9")], "clause_id string, position int, type string, subject int, object int, target_text string, evidence string, confidence string")
    out = outputs.build(e, r, clauses, rules=True)
    kept = {(x["entity_type"], x["name"]): (x["confidence"], x["review_status"]) for x in out["entities"].collect()}
    assert kept["department", "财务处"] == (0.98, "auto_approved") and kept["step", "审核"] == (0.9, "auto_approved") and ("approval_action", "审核") in kept
    told = {(x["relation_type"], x["evidence"]): x for x in out["relations"].collect()}
    assert set(told) == {("based_on", "《会计法》"), ("cites", "《会计法》"), ("performed_by", "由财务处审核"), ("performed_by", "审核")}
    good = told["performed_by", "由财务处审核"]
    ids = {x["entity_id"] for x in out["entities"].collect()}
    assert good["review_status"] == "auto_approved" and {good["subject_id"], good["object_id"]} <= ids and told["performed_by", "审核"]["review_status"] == "pending"
    assert sorted(x["issue_type"] for x in out["reviews"].collect()) == ["invalid_entity_type", "low_confidence_entity", "low_confidence_relation"]


def test_service_faults():
    from docgrid.sources.service import Service, ServiceError

    asked = []

    def transport(method, address, body, seconds):
        asked.append((method, address, body, seconds))
        if isinstance(answers[0], Exception):
            raise answers.pop(0)
        return answers.pop(0)

    service = Service("http://host:1/", transport)
    answers = [(200, b'{"a": 1}'), (200, b'{"b": 2}')]
    assert service.search("x y", 3, "2024-01-01") == {"a": 1} and service.answer("q") == {"b": 2}
    assert asked[0][:2] == ("GET", "http://host:1/policy-search?q=x+y&top_k=3&as_of=2024-01-01") and asked[1][0] == "POST" and asked[1][3] == 180.0
    for said, code in [((422, b""), "invalid_parameters"), ((404, b""), "not_found"), ((409, b""), "index_not_ready"), ((500, b"secret"), "service_unavailable"), ((200, b"{"), "invalid_response"), ((200, b"[]"), "invalid_response"), (TimeoutError(), "timeout"), (ConnectionError("secret"), "service_unavailable")]:
        answers = [said]
        with pytest.raises(ServiceError) as e:
            service.policy("a/b")
        assert e.value.code == code and "secret" not in str(e.value)
    assert asked[-1][1] == "http://host:1/api/policies/a%2Fb"
    for bad in ("ftp://x", "http://", "http://x?y=1"):
        with pytest.raises(ValueError):
            Service(bad)


def test_nothing_is_cut_and_no_file_kills_the_job(spark):
    """Long forms, numbers on a second page, titles on a later one, damaged and encrypted files beside a good one."""
    import io
    import zipfile

    from docgrid.operators import process, sections, tables

    rows = spark.createDataFrame([("b", 0, ["name", *[f"v{k}" for k in range(1500)]])], "block string, row int, cells array<string>")
    assert tables.form_fields(rows, "block", "row", "cells").first()["value"].split(" | ") == [f"v{k}" for k in range(1500)]
    assert len(tables.expand('<table><tr><td colspan="3000000">x</td><td rowspan="9999999">y</td></tr></table>')[0][0]) == 1001

    block = lambda k, page, text, raw="text", level=None: {"ordinal": k, "type": "text", "page_num": page, "content": text, "table_html": "", "raw_type": raw, "text_level": level}
    policy = [block(0, 1, "字" * 5000), block(1, 2, "校发〔2023〕7号\n发布机构：教务处"), block(2, 3, "采购管理办法\n第一条 按照规定办理。"), block(3, 5, "第二条 本办法自发布之日起施行。")]
    policy += [block(4, 5, "关于印发《学位授予规定》的通知"), block(5, 5, "学位授予规定"), block(6, 5, "第一条 总则。")]
    form = [block(0, 1, "申请表 姓名：张三 部门：财务处 金额：1,200元 签字 审批意见 申请人"), block(1, 2, "姓名：李四")]
    paper = [block(0, 1, "Deep learning for the mapping of things", "title", 1), block(1, 1, "Abstract: " + "We study things at length. " * 6), block(2, 1, "Introduction", "text", 2), block(3, 1, "References doi 10.1000/abc-1 2021 Keywords: x Conclusion Experiment Method")]
    data = [("p", "a.pdf", policy, {}, None), ("f", "申请表.pdf", form, {}, None), ("s", "paper.pdf", paper, {}, None), ("n", "x.pdf", [block(0, 1, "nothing much")], {}, None)]
    kind = "array<struct<ordinal:int,type:string,page_num:int,content:string,table_html:string,raw_type:string,text_level:int>>"
    out = process.process_documents(spark.createDataFrame(data, f"file_id string, file_name string, blocks {kind}, metadata map<string,string>, error string"))
    types = {r["file_id"]: r["doc_type"] for r in out["types"].collect()}
    about = {r["file_id"]: r for r in out["metadata"].collect()}
    assert types["p"] == "policy_regulation" and (about["p"]["doc_number"], about["p"]["issuer"]) == ("校发〔2023〕7号", "教务处")
    assert about["p"]["notice_title"] == "关于印发《学位授予规定》的通知" or about["p"]["title"] in ("学位授予规定", "采购管理办法")
    assert types["f"] == "admin_form" and (about["f"]["applicant"], about["f"]["department"], about["f"]["amount"], about["f"]["doc_number"]) == ("张三", "财务处", "1200", None)
    assert types["s"] == "academic_paper" and about["s"]["title"].startswith("Deep learning") and about["s"]["doi"] == "10.1000/abc-1" and about["s"]["abstract"]
    assert about["n"]["doc_number"] is None and about["n"]["applicant"] is None and about["n"]["doi"] is None

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:t>good words here</w:t></w:p></w:body></w:document>' + " " * 3000)
    good = packed.getvalue()
    at = good.index(b"document.xml") + len("document.xml")
    damaged, locked = bytearray(good), bytearray(good)
    damaged[at + 4 : at + 40] = b"\xff" * 36
    for sign in (b"PK\x03\x04", b"PK\x01\x02"):
        locked[good.index(sign) + (6 if sign[2] == 3 else 8)] |= 1
    mail = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=b\r\n\r\n--b\r\nContent-Type: text/html; charset=no-such-set\r\n\r\n<html><body><p>kept text</p></body></html>\r\n--b--\r\n"
    files = [("1", "a.docx", bytes(damaged)), ("2", "b.docx", bytes(locked)), ("3", "c.docx", good), ("4", "d.doc", mail), ("5", "e.docx", None)]
    got = {r["file_id"]: r for r in documents.parse_files(spark.createDataFrame(files, "file_id string, file_name string, content binary")).collect()}
    assert "damaged" in got["1"]["error"] and "damaged" in got["2"]["error"] and got["5"]["error"] and got["3"]["error"] is None and got["3"]["blocks"][0]["content"] == "good words here"
    assert got["4"]["error"] is None and got["4"]["blocks"][0]["content"] == "kept text"
    markdown = io.BytesIO()
    with zipfile.ZipFile(markdown, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("full.md", "# title " * 400)
    broken = bytearray(markdown.getvalue())
    broken[broken.index(b"full.md") + 9 : broken.index(b"full.md") + 25] = b"\xff" * 16
    read = {r["file_id"]: r["error"] for r in documents.read_artifacts(spark.createDataFrame([("x", bytes(broken)), ("y", markdown.getvalue())], "file_id string, content binary")).collect()}
    assert "damaged" in read["x"] and read["y"] is None

    long = "\n".join(f"paragraph {k} " + "x" * (k % 700) for k in range(3000))
    cut = [r["text"] for r in sections.chunk_documents(spark.createDataFrame([(1, long)], "doc_id long, text string")).orderBy("chunk_index").collect()]
    want, now = [], ""
    for p in map(str.strip, long.split("\n")):
        if len(now) + len(p) + 1 <= 512:
            now = f"{now}\n{p}" if now else p
            continue
        want += [now] if now else []
        now = "" if len(p) > 512 else p
        want += [p[s : s + 512] for s in range(0, len(p), 462)] if len(p) > 512 else []
    assert cut == want + ([now] if now else [])


def test_year_of_publication_is_no_other_number(spark):
    texts = ["On Supplier#000001900 and its kind 1900\nann2000@x.org, Received 12 May 2021", "No 0000019001, 2016", "20170501", "Accepted 3\n1999", "none"]
    b = spark.createDataFrame([(k, 1, 0, t, "text", None) for k, t in enumerate(texts)], "file_id int, page_num int, ordinal int, content string, raw_type string, text_level int")
    got = {r["file_id"]: r["year"] for r in metadata.academic(metadata.paper_heads(b, "file_id"), "file_id").collect()}
    assert got == {0: "2021", 1: "2016", 2: "2017", 3: "1999", 4: None}


def test_references_without_semicolon(spark):
    pages = spark.createDataFrame([(1, "<article><h1>a &amp;&amp</h1><p>&copy 1 &#38;lt; &nosuch; &lt;b&gt; &#x41; R&D</p></article>")], "page_id long, html string")
    said = lambda **k: [r["content"] for r in documents.page_blocks(pages, **k).orderBy("ordinal").collect()]
    assert said() == ["a &&", "© 1 &lt; &nosuch; <b> A R&D"]
    assert said(strict=True) == ["a &&amp", "&copy 1 &lt; &nosuch; <b> A R&D"]


def test_parts_beyond_six_digits_have_no_code(spark, tmp_path):
    spark.createDataFrame([(899_997, "a b", "t", 1), (900_000, "a b", "t", 1), (900_001, "c", "t", 1), (900_002, "d", "t", 7)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["p_partkey"]: (r["code"], r["title"]) for r in plans.table_identities(spark, str(tmp_path)).collect()}
    assert got == {899_997: ("X999997", "a b"), 900_000: ("", "a b"), 900_001: ("", "c"), 900_002: ("", "X17 t")}


def test_addresses_are_looked_for_once_in_a_run():
    began = time.time()
    assert re.search(metadata.EMAIL, "x" * 30_000 + " ,") is None and time.time() - began < 0.5
    assert re.search(metadata.EMAIL, "x@y, +a.b@c-d.org.").group() == "+a.b@c-d.org"


def test_types_with_their_cells(spark):
    rows = [(1, r, c, v) for r, cells in enumerate([["1", "a", "", "2,000"], ["2", "3", "", "2.5"]]) for c, v in enumerate(cells)] + [(2, 0, 0, "2024-01-05")]
    cells = spark.createDataFrame(rows, "id long, row_idx int, col_idx int, value string")
    got = tables.typed_cells(cells, ["id", "col_idx"])
    want = cells.join(tables.infer_types(cells, ["id", "col_idx"]), ["id", "col_idx"]).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_near_copies_and_products_are_bounded(monkeypatch):
    monkeypatch.setattr(vectors, "CELLS_AT_ONCE", 3_000)
    of = np.random.default_rng(1)
    some = np.concatenate([np.tile(of.normal(size=(1, 4)), (900, 1)), of.normal(size=(100, 4))])
    keys = of.permutation(1000)
    schema = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("similarity", pa.float64())])
    asked = some[[0, 950, 999]]
    found = vectors._nearest(20, schema)(pa.table({"key": keys, "v": some.tolist()}), pa.table({"query_id": [1, 2, 3], "q": asked.tolist()})).to_pylist()
    assert len(found) < 200
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.round(unit(asked) @ unit(some).T, 6)
    for q in range(3):
        want = sorted(zip(-near[q], keys.tolist(), strict=True))[:20]
        got = sorted((-round(r["similarity"], 6), r["key"]) for r in found if r["query_id"] == q + 1)[:20]
        assert got == want


def test_hashed_vectors_are_the_tokens_hashes(spark):
    texts = ["a b c a", "", None, "学 生 word " * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    hashes = {r["id"]: r["h"] for r in rows.select("id", F.transform(retrieval.tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("h")).collect()}
    out = providers.hashed_vectors(rows, "id", "text", 16)
    for r in out.collect():
        want = np.zeros(16)
        for h in hashes[r["id"]]:
            want[h % 16] += 1 if h >> 40 & 1 else -1
        assert np.allclose(r["embedding"], want / max(np.linalg.norm(want), 1e-12), atol=1e-7)
    # Python gets a short number for each token
    assert "smallint" in out._jdf.queryExecution().optimizedPlan().toString()


def test_spans_of_quantities_are_those_of_the_text(spark):
    texts = ["应当" + "x" * 25 + "30日", "住宿费不超过500元，应当在30日内，不超过 20 万元。另不少于3%；须在5 个工作日内", "每人每天12.5 元\n标准为7，上限8人民币 限期9年", "", "最高"]
    got = spark.createDataFrame([(t,) for t in texts], "t string")
    for sign, pattern in ((extraction.AMOUNT_SIGN, extraction.AMOUNT), (extraction.DEADLINE_SIGN, extraction.DEADLINE)):
        said = lambda k, p=pattern: F.regexp_extract_all("t", F.lit(p), F.lit(k))
        rows = got.select(said(1).alias("e"), said(2).alias("v"), said(3).alias("u"), extraction._quantities(F.col("t"), "x", sign, pattern, "?").alias("x")).collect()
        assert any(r["x"] for r in rows)
        for r in rows:
            assert [(x["value"], x["unit"]) for x in r["x"]] == [(float(v), u or "?") for v, u in zip(r["v"], r["u"], strict=True)]
            assert [x["evidence"] for x in r["x"]] == [e.strip(extraction.TRIM) for e in r["e"]]
