"""What a model says of clauses, turned into entities, relations and reviews.

Names of types are aligned, confidences put into their range, evidence looked up in the clause, relations' ends resolved to
the entities that stay, and what people should look at is listed.  Everything is joins and aggregations by clause, so
ids are hashes of what they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.text import evidence_supported, strip, text_or_blank

from . import extraction

CONFIDENT = 0.85

# The types of entities and relations, each with the words that mean it.
ENTITY_WORDS = {
    "matter": "matter 事项 办理事项", "process": "process 流程 办事流程", "step": "step 步骤 流程步骤", "role": "role 角色 办理角色 责任人", "location": "location 地点 办理地点", "department": "department 部门 责任部门",
    "audience": "audience 适用对象 人员", "material": "material 材料", "amount": "amount 金额", "deadline": "deadline 期限 时间期限", "approval_action": "approval_action 审批动作 审批", "condition": "condition 条件 前置条件", "outcome": "outcome 结果 办理结果",
}
RELATION_WORDS = {
    "applies_to": "applies_to 适用于", "has_process": "has_process 包含流程", "has_step": "has_step 包含步骤", "next_step": "next_step 下一步", "performed_by": "performed_by 由角色执行", "performed_at": "performed_at 在地点办理", "handled_by": "handled_by 由部门办理",
    "requires_material": "requires_material 需要材料", "has_amount": "has_amount 金额", "has_deadline": "has_deadline 期限", "requires_approval": "requires_approval 需要审批", "has_precondition": "has_precondition 前置条件", "routes_to": "routes_to 流转至",
    "produces": "produces 产生", "exception_to": "exception_to 异常转至", "cites": "cites 引用", "based_on": "based_on 依据", "revises": "revises 修订", "abolishes": "abolishes 废止", "replaces": "replaces 替代",
}
DOCUMENT_RELATIONS = ("cites", "based_on", "revises", "abolishes", "replaces")


def aligned(word: Column, words: dict[str, str]) -> Column:
    """The type that a word means; null for an unknown one."""
    pairs = [F.lit(x) for kind, said in words.items() for w in said.split() for x in (w, kind)]
    return F.element_at(F.create_map(*pairs), strip(word))


def clamped(confidence: Column) -> Column:
    """A number from 0 to 1; what isn't a number is 0."""
    c = F.coalesce(confidence.cast("string").try_cast("double"), F.lit(0.0))
    return F.when(F.isnan(c), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def _first(*columns: str) -> Column:
    """The first text that isn't blank, without white space around it."""
    return F.coalesce(*[F.when(strip(F.col(c)) != "", strip(F.col(c))) for c in columns], F.lit(""))


def _id(prefix: str, *parts: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[text_or_blank(F.col(p)) for p in parts]), 256), 1, 24))


def _status(valid: Column, rules: bool) -> Column:
    """What a model alone says waits for people; with rules beside it sure and proved results pass."""
    return F.when(F.lit(rules) & valid & (F.col("confidence") >= CONFIDENT), "auto_approved").otherwise("pending")


def build(entities: DataFrame, relations: DataFrame, clauses: DataFrame, rules: bool = False) -> dict[str, DataFrame]:
    """entities, relations and reviews of clauses (clause_id, raw_text).

    ``entities`` has clause_id, position, type, name, raw_text, evidence, confidence; ``relations`` has clause_id,
    position, type, subject and object (positions of entities), target_text, evidence, confidence.  With ``rules`` the
    rules' entities and citations are added: an entity's surest mention stays, and rules go before the model's relations.
    """
    source = clauses.select("clause_id", text_or_blank(F.col("raw_text")).alias("source"))
    e = entities.join(source, "clause_id").withColumn("kind", aligned(F.col("type"), ENTITY_WORDS)).withColumn("name", _first("name", "raw_text")).withColumn("evidence", _first("evidence", "raw_text"))
    e = e.withColumn("confidence", clamped(F.col("confidence"))).withColumn("review_status", _status((F.col("name") != "") & evidence_supported(F.col("evidence"), F.col("source")), rules))
    known = e.filter("kind IS NOT NULL").select("clause_id", "kind", "name", "evidence", "confidence", "review_status", F.lit(0).alias("from_rule"), "position")
    every = known
    if rules:
        r = extraction.rule_entities(clauses)
        every = known.unionByName(r.select("clause_id", F.col("entity_type").alias("kind"), "name", "evidence", "confidence", F.lit("auto_approved").alias("review_status"), F.lit(1).alias("from_rule"), F.col("ordinal").cast(known.schema["position"].dataType).alias("position")))
    best = Window.partitionBy("clause_id", "kind", "name").orderBy(F.desc("confidence"), "from_rule", "position")
    kept = every.withColumn("place", F.row_number().over(best)).filter("place = 1").withColumn("entity_id", _id("entity_", "clause_id", "kind", "name"))
    kept = kept.select("entity_id", "clause_id", F.col("kind").alias("entity_type"), "name", "evidence", "confidence", "review_status")

    ends = known.select("clause_id", "position", _id("entity_", "clause_id", "kind", "name").alias("entity_id"))
    end = lambda side: ends.select("clause_id", F.col("position").alias(side), F.col("entity_id").alias(f"{side}_id"))
    m = relations.select("clause_id", F.lit(1).alias("order"), "position", aligned(F.col("type"), RELATION_WORDS).alias("kind"), "subject", "object", strip(F.col("target_text")).alias("target_text"), _first("evidence", "target_text").alias("evidence"), clamped(F.col("confidence")).alias("confidence"))
    m = m.join(end("subject"), ["clause_id", "subject"], "left").join(end("object"), ["clause_id", "object"], "left").drop("subject", "object")
    if rules:
        cited = extraction.reference_relations(clauses)
        m = m.unionByName(cited.select("clause_id", F.lit(0).alias("order"), F.col("ordinal").cast(m.schema["position"].dataType).alias("position"), F.col("relation_type").alias("kind"), F.col("target").alias("target_text"), F.col("target").alias("evidence"), "confidence", F.lit(None).cast("string").alias("subject_id"), F.lit(None).cast("string").alias("object_id")))
    m = m.join(source, "clause_id")
    ended = F.when(F.col("kind").isin(*DOCUMENT_RELATIONS), F.col("target_text") != "").otherwise(F.col("subject_id").isNotNull() & F.col("object_id").isNotNull())
    m = m.withColumn("valid", evidence_supported(F.col("evidence"), F.col("source")) & ended)
    first = Window.partitionBy("clause_id", "kind", "target_text", "evidence").orderBy("order", "position")
    once = m.filter("kind IS NOT NULL").withColumn("place", F.row_number().over(first)).filter("place = 1").withColumn("review_status", _status(F.col("valid"), rules)).withColumn("relation_id", _id("relation_", "clause_id", "kind", "target_text", "evidence"))

    review = lambda df, issue, what: df.select("clause_id", F.lit(issue).alias("issue_type"), what.alias("candidate_id"), "evidence")
    none = F.lit(None).cast("string")
    reviews = review(e.filter("kind IS NULL"), "invalid_entity_type", none).unionByName(review(m.filter("kind IS NULL"), "invalid_relation_type", none))
    reviews = reviews.unionByName(review(once.filter(~F.col("valid") | (F.col("confidence") < CONFIDENT)), "low_confidence_relation", F.col("relation_id")))
    if rules:
        reviews = reviews.unionByName(review(known.filter("review_status = 'pending'"), "low_confidence_entity", _id("entity_", "clause_id", "kind", "name")))
    told = once.select("relation_id", "clause_id", F.col("kind").alias("relation_type"), "subject_id", "object_id", "target_text", "evidence", "confidence", "review_status")
    return {"entities": kept, "relations": told, "reviews": reviews}
