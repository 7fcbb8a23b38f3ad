"""From parsed files to products: types, metadata, chunks, tables, forms, clauses, abolition links and lineage."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.functions import ids, rules
from docgrid.functions.text import is_blank, squash, strip, text_or_blank

from . import extraction, governance, hierarchy, ledger, metadata, sections, tables

VERSION = "v1"
# How a sentence says when a target was published, and how far it looks for it.
PUBLISHED = r"((?:19|20)[0-9]{2})\s*年\s*(?:[0-9]{1,2}\s*月\s*(?:[0-9]{1,2}\s*日\s*)?)?(?:印发|发布|颁布|制定)\s*的?\s*"


def blocks_of(parsed: DataFrame) -> DataFrame:
    """A row for each block of parsed files (file_id, file_name, blocks)."""
    return parsed.select("file_id", "file_name", F.explode("blocks").alias("b")).select("file_id", "file_name", "b.*")


def process_documents(parsed: DataFrame) -> dict[str, DataFrame]:
    """All products of parsed files: types, metadata, chunks, tables, cells, forms, clauses, relations and lineage.

    Every product is a plan of its own over the blocks; nothing runs until one is read or written.
    """
    b = blocks_of(parsed)
    texts = b.filter((F.col("type") == "text") & ~is_blank(F.col("content")))
    pages = b.groupBy("file_id").agg(F.max("page_num").alias("pages"))
    whole = sections.prefix_budget(texts, "file_id", ["page_num", "ordinal"], "content")
    part = F.struct("page_num", "ordinal", "kept")
    whole = whole.groupBy("file_id", "file_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["kept"]), "\n").alias("text")).join(pages, "file_id")
    types = rules.document_types(whole, rules.type_signals(whole, "file_id", "text", "file_name", "pages"), "file_id")

    grids = b.filter("type = 'table'").select(F.concat_ws(":", "file_id", "ordinal").alias("block"), "table_html")
    structure = tables.structures(grids, "block", "table_html").withColumn("category", tables.table_class(F.col("headers"), F.col("rows")))
    cells = tables.long_cells(structure.filter("category = 'data_table'"), "block")
    forms = tables.form_fields(structure.filter("category = 'form'").select("block", F.posexplode("rows").alias("row", "cells")), "block", "row", "cells")

    policies = types.filter("doc_type = 'policy_regulation'").select("file_id")
    lines = sections.policy_lines(texts.join(policies, "file_id", "left_semi"), "file_id", ["page_num", "ordinal"], "content")
    lines = lines.select(ids.policy_id(F.col("file_id"), F.lit("")).alias("policy_id"), F.col("page_num").alias("page"), "ordinal", "line_no", "line")
    clauses = hierarchy.build_clauses(lines)
    clauses = clauses.withColumn("clause_id", ids.clause_id(F.col("policy_id"), F.lit(VERSION), F.col("sequence_no"), F.col("raw_text"))).withColumn("structure_version", F.lit(VERSION)).withColumn("is_active", F.lit(True))
    # titles are looked for in all lines, the fields of a document's type in its own first pages
    said = texts.select("file_id", "page_num", "ordinal", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    said = said.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "ordinal", "line_no", "line"))), lambda x: F.struct(x["page_num"].alias("page"), x["line"].alias("line"))).alias("lines"))
    own = metadata.confirmed_titles(F.transform("lines", lambda x: x["line"]))
    guessed = metadata.guess_title(F.col("file_name"), rules.low_confidence_name(F.col("file_name")), F.col("lines"))
    about = parsed.select("file_id", "file_name").join(said, "file_id", "left").withColumn("own", own)
    about = about.select("file_id", F.coalesce("own.title", guessed).alias("title"), F.col("own.notice_title").alias("notice_title"))
    named = [F.col(c) if c in texts.columns else F.lit(None).cast(t).alias(c) for c, t in (("raw_type", "string"), ("text_level", "int"))]
    fields = metadata.by_type(types.select("file_id", "doc_type"), texts.select("file_id", "page_num", "ordinal", "content", *named), "file_id")
    about = about.join(types.select("file_id", "doc_type"), "file_id", "left").join(fields, "file_id", "left").withColumn("title", F.when(F.col("doc_type") == "academic_paper", F.coalesce("paper_title", "title")).otherwise(F.col("title"))).drop("paper_title")
    chunks = sections.chunk_documents(texts.select(F.concat_ws(":", "file_id", "ordinal").alias("block"), F.col("content").alias("text")), "block")
    target = F.when(F.col("type") == "table", "tables").when(F.col("type") == "image", "images").otherwise("chunks")
    return {
        "types": types, "metadata": about, "chunks": chunks, "tables": structure.drop("rows"), "cells": cells, "forms": forms, "clauses": clauses,
        "relations": extraction.abolition_candidates(clauses), "lineage": b.select("file_id", "ordinal", "type", "page_num", target.alias("target")), "errors": parsed.filter("error IS NOT NULL").select("file_id", "error"),
    }


def target_year(evidence: Column, title: Column) -> Column:
    """The only year in which the evidence says that its quoted title was published, right before the title."""
    e = text_or_blank(evidence)
    pick = lambda g: F.regexp_extract_all(e, F.lit(PUBLISHED + extraction.QUOTED), F.lit(g))
    said = F.filter(F.arrays_zip(pick(1).alias("year"), pick(2).alias("title")), lambda q: squash(q["title"]) == squash(title))
    years = F.array_distinct(F.transform(said, lambda q: q["year"]))
    return F.when(F.size(years) == 1, F.get(years, F.lit(0)).cast("int"))


def abolition_relations(clauses: DataFrame, documents: DataFrame) -> DataFrame:
    """Pending relations of clauses (clause_id, policy_id, raw_text) with their target where exactly one fits."""
    c = extraction.abolition_candidates(clauses).join(clauses.select("clause_id", F.col("policy_id").alias("source_policy_id")), "clause_id")
    c = c.withColumn("relation_id", F.concat(F.lit("relation_"), F.substr(F.sha2(F.concat_ws("␟", "source_policy_id", "clause_id", "target_title", "target_doc_number"), 256), F.lit(1), F.lit(24))))
    c = c.withColumn("target_year", target_year(F.col("evidence"), F.col("target_title"))).dropDuplicates(["relation_id"])
    found = governance.resolve_targets(c, documents)
    return c.join(found, "relation_id", "left").select("relation_id", "source_policy_id", "target_policy_id", "target_title", "target_doc_number", "effective_date", "evidence", F.col("clause_id").alias("evidence_clause_id"), F.when(F.col("effective_date").isNotNull(), 1.0).otherwise(0.7).alias("confidence"), F.lit("pending").alias("review_status"))


def reconcile(relations: DataFrame, documents: DataFrame, policy_id: str) -> DataFrame:
    """Pending relations without a target which a newly stored document now answers, with it as their target."""
    waiting = relations.filter("review_status = 'pending' AND target_policy_id IS NULL").withColumn("target_year", target_year(F.col("evidence"), F.col("target_title")))
    found = governance.resolve_targets(waiting, documents).filter(F.col("target_policy_id") == policy_id)
    return waiting.drop("target_policy_id", "target_year").join(found, "relation_id").select(*relations.columns)


def review_relations(relations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Relations after people's decisions (relation_id, decision, target_policy_id, effective_date).

    Only pending relations change; approval needs a target that isn't the source, otherwise the relation stays pending.
    """
    d = decisions.select("relation_id", F.struct("decision", "target_policy_id", "effective_date").alias("__d"))
    r = relations.join(d, "relation_id", "left")
    target = F.coalesce("__d.target_policy_id", "target_policy_id")
    open_ = (F.col("review_status") == "pending") & F.col("__d").isNotNull()
    approve = open_ & (F.col("__d.decision") == "approved") & target.isNotNull() & (target != F.col("source_policy_id"))
    approve, reject = F.coalesce(approve, F.lit(False)), F.coalesce(open_ & (F.col("__d.decision") == "rejected"), F.lit(False))
    new = {"target_policy_id": F.when(approve, target).otherwise(F.col("target_policy_id")), "effective_date": F.when(approve, F.coalesce("__d.effective_date", "effective_date")).otherwise(F.col("effective_date")), "review_status": F.when(approve, "approved").when(reject, "rejected").otherwise(F.col("review_status"))}
    return r.select(*[new.get(c, F.col(c)).alias(c) for c in relations.columns])


def run_items(items: DataFrame, work: Callable[[DataFrame], DataFrame], now: Column, resume: bool = False, key: str = "item_id") -> DataFrame:
    """One pass of a run: eligible items are worked on (``work`` gives key, ok, error) and all items get their new state."""
    taken = items.filter(ledger.eligible(now, resume))
    done = work(taken).select(key, "ok", "error")
    moved = ledger.after_attempt(taken.join(done, key), now)
    changed = {"status": "new_status", "attempt_count": "new_attempt_count", "error_kind": "new_error_kind", "next_retry_at": "new_retry_at"}
    moved = moved.select(*[F.col(changed.get(c, c)).cast(items.schema[c].dataType).alias(c) for c in items.columns])
    return items.join(moved.select(key), key, "left_anti").select(*items.columns).unionByName(moved)


def report(summary: DataFrame, codes: DataFrame) -> str:
    """A quality summary (one row) and error codes as a Markdown report."""
    row = summary.first().asDict()
    lines = ["# Quality report", "", "| figure | value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in row.items()], "", "| error code | count |", "| --- | --- |"]
    return "\n".join([*lines, *[f"| {r['code']} | {r['n']} |" for r in codes.orderBy(F.desc("n"), "code").collect()]]) + "\n"


def annotate(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Annotations from decisions: corrections need a label, evidence must be in the clause; error says what is wrong."""
    j = decisions.join(candidates.select("candidate_id", "raw_text"), "candidate_id", "left")
    said = strip(F.col("evidence_text"))
    error = F.coalesce(
        F.when(~F.col("decision").isin("approved", "rejected", "corrected", "added"), "unknown decision"), F.when(F.col("raw_text").isNull() & (F.col("decision") != "added"), "unknown candidate"),
        F.when((F.col("decision") == "corrected") & is_blank(F.col("label")), "a correction needs a label"), F.when((said != "") & ~F.contains(F.col("raw_text"), said), "evidence isn't in the clause"),
    )
    return j.withColumn("error", error).drop("raw_text")
