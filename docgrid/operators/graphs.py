"""Entity and relation graphs: candidates, reviewed workflow graphs, document types, assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.ids import assertion_id
from docgrid.functions.text import evidence_supported, text_or_blank

VISIBLE = ("approved", "auto_approved", "corrected")
# States of assertions that may be used, and the kinds and modalities there are.
USABLE = ("machine_extracted", "approved", "corrected")
KINDS = ("action", "condition", "definition", "scope", "standard", "status", "reference")
MODALITIES = ("required", "permitted", "prohibited", "factual")


def graph_candidates(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities and relations in one table, relations with the names of both ends."""
    e = entities.select(F.col("entity_id").alias("candidate_id"), F.lit("entity").alias("candidate_type"), "name", F.lit(None).cast("string").alias("subject_name"), F.lit(None).cast("string").alias("object_name"))
    s = entities.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("subject_name"))
    o = entities.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object_name"))
    r = relations.join(s, "subject_id", "left").join(o, "object_id", "left")
    return e.unionByName(r.select(F.col("relation_id").alias("candidate_id"), F.lit("relation").alias("candidate_type"), F.col("relation_type").alias("name"), "subject_name", "object_name"))


def best_entities(entities: DataFrame) -> DataFrame:
    """The most confident entity of each type and name; the first wins ties."""
    w = Window.partitionBy("entity_type", "name").orderBy(F.desc("confidence"), "ordinal")
    return entities.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def workflow_graph(candidates: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name) and edges (id, subject_id, object_id) that are visible after the latest human decision.

    ``candidates`` has candidate_id, candidate_type, name, subject_id, object_id, review_status; ``annotations`` has
    candidate_id, decision, label, created_at, annotation_id.  Edges with an end that isn't visible are dropped.
    """
    last = annotations.groupBy("candidate_id").agg(F.max_by(F.struct("decision", "label"), F.struct("created_at", "annotation_id")).alias("a"))
    c = candidates.join(last, "candidate_id", "left")
    seen = F.when(F.col("a").isNotNull(), F.col("a.decision") != "rejected").otherwise(F.col("review_status").isin(*VISIBLE))
    c = c.filter(seen).withColumn("name", F.when(F.col("a.decision") == "corrected", F.col("a.label")).otherwise(F.col("name")))
    nodes = c.filter("candidate_type = 'entity'").select(F.col("candidate_id").alias("id"), "name")
    edges = c.filter("candidate_type = 'relation'").select(F.col("candidate_id").alias("id"), "subject_id", "object_id")
    for end in ("subject_id", "object_id"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, edges.select("id", "subject_id", "object_id")


def document_type_graph(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of categories that contain document types, which apply to usages.

    ``items`` has category, document_type, usage, evidence and source; unsupported evidence is left out.
    """
    ok = items.filter(evidence_supported(F.col("evidence"), F.col("source")))
    pairs = ok.select(F.explode(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")), F.struct(F.lit("document_type").alias("kind"), F.col("document_type").alias("name")), F.struct(F.lit("usage").alias("kind"), F.col("usage").alias("name")))).alias("n"))
    nodes = pairs.select("n.*").filter(text_or_blank(F.col("name")) != "").distinct()
    e = ok.select(F.explode(F.array(F.struct(F.lit("contains").alias("relation"), F.col("category").alias("a"), F.col("document_type").alias("b")), F.struct(F.lit("applies_to").alias("relation"), F.col("document_type").alias("a"), F.col("usage").alias("b")))).alias("e"))
    return nodes, e.select("e.*").filter("a <> '' AND b <> ''").distinct()


def check_assertions(assertions: DataFrame, clauses: DataFrame) -> DataFrame:
    """Assertions with error (null if valid), repaired start and end, and their content id; equal ones once.

    ``assertions`` has clause_id, kind, modality, subject, predicate, object, evidence, start, end (offsets from 0);
    ``clauses`` has clause_id and raw_text.  An offset that doesn't fit is repaired when the evidence occurs once.
    """
    a = assertions.join(clauses, "clause_id", "left")
    source, said = text_or_blank(F.col("raw_text")), text_or_blank(F.col("evidence"))
    fits = F.substr(source, F.col("start") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0))) == said
    first = F.instr(source, said)
    once = (first > 0) & (F.instr(F.substr(source, first + 1), said) == 0)
    fits = F.coalesce(fits, F.lit(False)) & (said != "")
    start = F.when(fits, F.col("start")).when(once, first - 1)
    supported = lambda c: (text_or_blank(F.col(c)) == "") | F.contains(source, text_or_blank(F.col(c)))
    error = F.coalesce(
        F.when(F.col("raw_text").isNull(), "unknown clause"), F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind"), F.when(~F.coalesce(F.col("modality").isin(*MODALITIES), F.lit(False)), "unknown modality"),
        F.when(said == "", "no evidence"), F.when(start.isNull(), "evidence isn't in the clause once"), F.when(~supported("subject"), "unsupported subject"), F.when(~supported("object"), "unsupported object"),
    )
    out = a.withColumn("error", error).withColumn("start", start).withColumn("end", start + F.length(said))
    parts = [text_or_blank(F.col(c)) for c in ("clause_id", "kind", "modality", "subject", "predicate", "object", "evidence")]
    out = out.withColumn("assertion_id", assertion_id(*parts)).drop("raw_text")
    return out.dropDuplicates(["assertion_id"])


def usable(assertions: DataFrame, status: str = "status") -> DataFrame:
    return assertions.filter(F.col(status).isin(*USABLE))


def visible_context(assertions: DataFrame, shown: DataFrame) -> DataFrame:
    """Only assertions whose evidence clause was among those shown."""
    return assertions.join(shown.select("clause_id").distinct(), "clause_id", "left_semi")


def evidence_span(source: Column, evidence: Column) -> Column:
    """Start (from 0) of evidence that occurs exactly once, else null."""
    at = F.instr(source, evidence)
    return F.when((at > 0) & (F.instr(F.substr(source, at + 1), evidence) == 0), at - 1)
