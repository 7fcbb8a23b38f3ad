"""Validity in time, families, relation targets and effective dates of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.text import effective_dates, normalize_document_number, publication_year, says_relative_date, squash
from docgrid.operators import sweeps


def temporal_status(as_of: Column, today: Column, effective: Column, expiry: Column, validity: Column) -> Column:
    """applicable, inapplicable or unknown on a day; intervals are closed on the left and open on the right."""
    return (
        F.when(effective.isNotNull() & (as_of < effective), "inapplicable")
        .when(expiry.isNotNull() & (as_of >= expiry), "inapplicable")
        .when((validity == "invalid") & expiry.isNull(), F.when(as_of >= today, "inapplicable").otherwise("unknown"))
        .when(validity == "unknown", "unknown")
        .when((validity == "current") | (validity == "invalid"), "applicable")
        .otherwise(F.when(effective.isNotNull(), "applicable").otherwise("unknown"))
    )


def temporal_rank(candidates: DataFrame, documents: DataFrame, as_of: Column, today: Column, top_k: int, key: str = "policy_id", clause: str = "clause_id") -> DataFrame:
    """Candidates that may apply on a day, best score first, applicable before unknown."""
    d = documents.select(key, "effective_date", "expiry_date", "validity_status", "family_id")
    c = candidates.join(d, key, "left")
    status = temporal_status(as_of, today, F.col("effective_date"), F.col("expiry_date"), F.coalesce("validity_status", F.lit("")))
    c = c.withColumn("temporal_status", status).filter("temporal_status <> 'inapplicable'")
    return c.orderBy(F.desc("score"), F.when(F.col("temporal_status") == "applicable", 0).otherwise(1), clause).limit(top_k)


def family_warnings(ranked: DataFrame, family: str = "family_id", key: str = "policy_id") -> DataFrame:
    """Families of which more than one version applies, with their ids in order."""
    ids = ranked.filter((F.col("temporal_status") == "applicable") & F.col(family).isNotNull()).groupBy(family).agg(F.array_sort(F.collect_set(key)).alias("ids"))
    return ids.filter(F.size("ids") > 1).select(family, F.array_join("ids", ",").alias("policy_ids"), F.size("ids").alias("n_versions"))


def family_overlaps(versions: DataFrame, family: str, key: str, start: str, end: str) -> DataFrame:
    """Pairs of a family's versions whose intervals [start, end) overlap, both starts known, an open end being null."""
    return sweeps.overlaps(versions, family, key, start, end)


def same_title_pairs(documents: DataFrame, title: str, key: str) -> DataFrame:
    """Links of documents with one title: each with the first of its title, so links grow as documents and not as pairs."""
    first = F.min(key).over(Window.partitionBy(title))
    return documents.filter(F.col(title) != "").select(title, first.alias("left_id"), F.col(key).alias("right_id")).filter("left_id <> right_id")


ANY_YEAR = -1


def target_keys(documents: DataFrame) -> DataFrame:
    """want, y, n, least, greatest: by normalised number or title and year of publication (or any), how many documents
    there are and the first and last of their ids, which tells whether exactly one other than a given one is there."""
    wants = F.array(F.concat(F.lit("n"), normalize_document_number(F.col("doc_number"))), F.concat(F.lit("t"), squash(F.col("title"))))
    d = documents.select("policy_id", F.coalesce(publication_year(F.col("doc_number"), F.col("issue_date")).cast("int"), F.lit(ANY_YEAR)).alias("year"), F.explode(wants).alias("want"))
    d = d.filter(F.length("want") > 1).select("policy_id", "want", F.explode(F.array_distinct(F.array("year", F.lit(ANY_YEAR)))).alias("y")).distinct()
    return d.groupBy("want", "y").agg(F.count("*").alias("n"), F.min("policy_id").alias("least"), F.max("policy_id").alias("greatest"))


def wanted_keys(relations: DataFrame) -> DataFrame:
    """relation_id, source_policy_id, want, y of relations: the number if one is given, else the title."""
    number = normalize_document_number(F.col("target_doc_number"))
    want = F.when(number != "", F.concat(F.lit("n"), number)).otherwise(F.concat(F.lit("t"), squash(F.col("target_title"))))
    return relations.select("relation_id", "source_policy_id", want.alias("want"), F.coalesce(F.col("target_year").cast("int"), F.lit(ANY_YEAR)).alias("y"))


def matched(wanted: DataFrame, targets: DataFrame) -> DataFrame:
    """relation_id and target_policy_id of wanted keys: the only document under the key that isn't the source."""
    source = F.col("source_policy_id")
    one = F.when((F.col("n") == 1) & (F.col("least") != source), F.col("least"))
    two = F.when(F.col("n") == 2, F.when(F.col("least") == source, F.col("greatest")).when(F.col("greatest") == source, F.col("least")))
    return wanted.join(targets, ["want", "y"], "left").select("relation_id", F.coalesce(one, two).alias("target_policy_id"))


def store_keys(keys: DataFrame, table: str, buckets: int = 64) -> None:
    """Write target or wanted keys as a table in buckets, so that ``matched`` joins two such tables without a shuffle."""
    keys.repartition(buckets, "want", "y").write.mode("overwrite").bucketBy(buckets, "want", "y").sortBy("want", "y").saveAsTable(table)


def resolve_targets(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """relation_id and target_policy_id: the only other document with the number, or if none is given with the title.

    ``relations`` has relation_id, source_policy_id, target_title, target_doc_number and target_year (null: any).
    """
    return matched(wanted_keys(relations), target_keys(documents))


def effective_date_status(texts: DataFrame, key: str, text: str, issue_date: str) -> DataFrame:
    """key, effective_date, status (identified, conflict, needs_review, unknown) from all texts of a document."""
    each = texts.select(key, F.col(issue_date).alias("issued"), effective_dates(F.col(text)).alias("said"), says_relative_date(F.col(text)).alias("relative"))
    each = each.withColumn("said", F.when(F.col("relative") & F.col("issued").isNotNull(), F.array_union("said", F.array("issued"))).otherwise(F.col("said")))
    days = each.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("said"))).alias("days"), F.bool_or("relative").alias("relative"))
    status = F.when(F.size("days") > 1, "conflict").when(F.size("days") == 1, "identified").otherwise(F.when(F.col("relative"), "needs_review").otherwise("unknown"))
    return days.select(key, F.when(F.size("days") == 1, F.get("days", F.lit(0))).alias("effective_date"), status.alias("status"))


def distinct_date_status(rows: DataFrame, key: str, day: str) -> DataFrame:
    """The same decision where each row already has its date (or null)."""
    g = rows.groupBy(key).agg(F.countDistinct(day).alias("n"), F.min(day).alias("d"))
    return g.select(key, F.when(F.col("n") == 1, F.col("d")).alias("effective_date"), F.when(F.col("n") > 1, "conflict").when(F.col("n") == 1, "identified").otherwise("unknown").alias("status"))


def backfill_validity(documents: DataFrame, relations: DataFrame, key: str = "policy_id") -> DataFrame:
    """Pending conflicts make a document's validity unknown, others without a value are current."""
    pending = relations.filter((F.col("review_status") == "pending") & F.col("target_policy_id").isNotNull()).select(F.col("target_policy_id").alias(key)).distinct().withColumn("__pending", F.lit(True))
    d = documents.join(pending, key, "left")
    return d.withColumn("validity_status", F.when(F.col("validity_status") == "invalid", "invalid").when(F.col("__pending"), "unknown").otherwise("current")).drop("__pending")
