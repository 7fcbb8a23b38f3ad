"""Documents and clauses as governed tables: selections, upserts, replacements, links and cleanups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.text import is_blank, squash, strip, text_or_blank

# Levels of clauses for each use, kinds of conflicts, and the shortest text worth extracting from.
SEARCHABLE = ("article", "paragraph", "item")
SUBSTANTIVE = ("preamble", "article", "paragraph", "item")
HEADINGS = ("book", "chapter", "section")
CONFLICTS = ("effective_date_conflict", "validity_conflict", "version_conflict")
LEAST_CHARS = 20
EXPANSION, EXPANSION_SHARE = 6, 0.9
LABELS = (("obligation", "义务"), ("permission", "许可"), ("prohibition", "禁止"), ("other", "其他"))
TYPE_PARENT = r"公文种类包括\s*[：:]?"
TYPE_ITEM = r"^\s*[（(][一二三四五六七八九十百\d]+[）)]\s*([^。．.：:；;\n]{1,30})[。．.]\s*适用于([^。！？!?]+)"


def searchable(level: Column, raw_text: Column) -> Column:
    return level.isin(*SEARCHABLE) & ~is_blank(raw_text)


def substantive(level: Column, raw_text: Column, search_text: Column) -> Column:
    return level.isin(*SUBSTANTIVE) & ~(is_blank(raw_text) & is_blank(search_text))


def extraction_selection(clauses: DataFrame, documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Clauses to extract from, in order of file name, policy and sequence: no headings, at least 20 characters."""
    c = clauses.filter((F.length(strip(F.col("search_text"))) >= LEAST_CHARS) & ~F.col("level").isin(*HEADINGS))
    out = c.join(documents.select("policy_id", "file_name"), "policy_id").orderBy("file_name", "policy_id", "sequence_no")
    return out.limit(limit) if limit else out


def eligible_labels(labels: DataFrame, clauses: DataFrame, enabled: list[str]) -> DataFrame:
    """Process labels that may lead to extraction: approved, with known domains and evidence from the clause."""
    ok = (F.col("decision") == "process") & F.col("review_status").isin("auto_approved", "approved") & (F.size("domains") > 0)
    known = F.size(F.array_except("domains", F.array(*[F.lit(d) for d in enabled]))) == 0
    said = strip(F.col("evidence_text"))
    return labels.filter(ok & known).join(clauses, "clause_id").filter((said != "") & F.contains(F.col("raw_text"), said)).orderBy("sequence_no", "clause_id")


def active_clauses(clauses: DataFrame, documents: DataFrame) -> DataFrame:
    """Clauses of each document's current structure that are active."""
    return clauses.filter("is_active").join(documents.select("policy_id", "structure_version"), ["policy_id", "structure_version"])


def batch_documents(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Structured documents of a batch's files, whether processed or reused; each once."""
    files = items.select(F.coalesce("reuse_file_id", "file_id").alias("file_id")).filter("file_id IS NOT NULL").distinct()
    return documents.filter("structure_status = 'succeeded'").join(files, "file_id", "left_semi")


def upsert_documents(old: DataFrame, new: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """New rows over old ones: dates stay unless the source says its pages, invalid stays invalid, open conflicts are unknown."""
    pending = reviews.filter((F.col("status") == "pending") & F.col("issue_type").isin(*CONFLICTS)).select("policy_id").distinct().withColumn("__open", F.lit(True))
    o = old.join(pending, "policy_id", "left").select(*keys, F.struct(*old.columns, "__open").alias("o"))
    both = o.join(new.select(*keys, F.struct(*new.columns).alias("n")), keys, "full")
    own = F.col("n.source_page_start").isNotNull()
    picked = {c: F.col(f"n.{c}") for c in old.columns}
    for c in ("effective_date", "expiry_date"):
        picked[c] = F.when(own, F.col(f"n.{c}")).otherwise(F.coalesce(f"o.{c}", f"n.{c}"))
    picked["validity_status"] = F.when(F.col("o.validity_status") == "invalid", "invalid").when(F.col("o.__open"), "unknown").otherwise(F.col("n.validity_status"))
    picked["policy_id"] = F.coalesce("o.policy_id", "n.policy_id")
    return both.select(*[F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(v).alias(c) for c, v in picked.items()])


def replace_clauses(old: DataFrame, new: DataFrame) -> DataFrame:
    """A document's new clauses over its old ones: what isn't replaced is deactivated, other documents stay."""
    touched = new.select("policy_id").distinct().withColumn("__mine", F.lit(True))
    kept = old.join(new.select("clause_id"), "clause_id", "left_anti").join(touched, "policy_id", "left")
    kept = kept.withColumn("is_active", F.when(F.col("__mine"), F.lit(False)).otherwise(F.col("is_active"))).select(*old.columns)
    return kept.unionByName(new.select(*old.columns))


def backfill_names(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog rows with their file's present name where it differs, nulls included."""
    f = files.select("file_id", F.col("file_name").alias("__name"))
    return catalog.join(f, "file_id", "left").withColumn("file_name", F.when(F.col("__name").isNotNull() & ~F.col("__name").eqNullSafe(F.col("file_name")), F.col("__name")).otherwise(F.col("file_name"))).drop("__name")


def upsert_family_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Candidates by (source, target, reason): the first relation and the first title that isn't empty stay."""
    keys = ["source_policy_id", "target_policy_id", "reason"]
    both = old.withColumn("__k", F.lit(0)).unionByName(new.withColumn("__k", F.lit(1)))
    title = F.when(F.col("normalized_title") != "", F.struct("__k", "normalized_title"))
    g = both.groupBy(*keys).agg(F.min(F.when(F.col("relation_id").isNotNull(), F.struct("__k", "relation_id"))).alias("r"), F.min(title).alias("t"))
    return g.select(*keys, F.col("r.relation_id").alias("relation_id"), F.coalesce("t.normalized_title", F.lit("")).alias("normalized_title"))


def relation_counts(relations: DataFrame) -> DataFrame:
    s, t = F.col("review_status"), F.col("target_policy_id")
    return relations.agg(F.count("*").alias("total"), *[F.count_if(s == x).alias(x) for x in ("pending", "approved", "rejected")], F.count_if(t.isNotNull()).alias("resolved"), F.count_if(t.isNull()).alias("unresolved"))


def date_conflicts(relations: DataFrame) -> DataFrame:
    """Targets whose approved relations say different days."""
    r = relations.filter((F.col("review_status") == "approved") & F.col("effective_date").isNotNull() & F.col("target_policy_id").isNotNull())
    return r.groupBy("target_policy_id").agg(F.countDistinct("effective_date").alias("n_dates")).filter("n_dates > 1")


def recompute_targets(documents: DataFrame, relations: DataFrame, gone: DataFrame, reviews: DataFrame) -> DataFrame:
    """Documents after relations (``gone``: relation_id) are deleted: validity and expiry of those relations' targets.

    A target with other approved relations stays invalid from their day; without any it is current again unless a day
    of its own or an open conflict says otherwise.  A day that came from a deleted relation goes with it.
    """
    r = relations.join(gone.select("relation_id").withColumn("__gone", F.lit(True)), "relation_id", "left").filter((F.col("review_status") == "approved") & F.col("target_policy_id").isNotNull())
    left, lost = F.col("__gone").isNull(), F.col("__gone").isNotNull()
    day = F.col("effective_date")
    g = r.groupBy(F.col("target_policy_id").alias("policy_id")).agg(F.count_if(lost).alias("lost"), F.count_if(left).alias("left"), F.min(F.when(left, day)).alias("left_day"), F.collect_set(F.when(lost, day)).alias("lost_days"))
    open_ = reviews.filter((F.col("status") == "pending") & F.col("issue_type").isin(*CONFLICTS)).select("policy_id").distinct().withColumn("__open", F.lit(True))
    d = documents.join(g.filter("lost > 0"), "policy_id", "left").join(open_, "policy_id", "left")
    expiry = F.when(F.col("lost").isNull(), F.col("expiry_date")).when(F.col("left_day").isNotNull(), F.col("left_day")).when(F.array_contains("lost_days", F.col("expiry_date")), None).otherwise(F.col("expiry_date"))
    d = d.withColumn("expiry_date", expiry)
    state = F.when(F.col("lost").isNull(), F.col("validity_status")).when((F.col("left") > 0) | F.col("expiry_date").isNotNull(), "invalid").when(F.col("__open"), "unknown").otherwise("current")
    return d.withColumn("validity_status", state).select(*documents.columns)


def migrate_evidence(relations: DataFrame, clauses: DataFrame) -> DataFrame:
    """relation_id and the only clause of its document that holds its evidence, white space disregarded."""
    c = clauses.select(F.col("policy_id").alias("source_policy_id"), "clause_id", squash(F.col("raw_text")).alias("__t"))
    hit = relations.select("relation_id", "source_policy_id", squash(F.col("evidence_text")).alias("__e")).filter("__e <> ''").join(c, "source_policy_id").filter(F.contains(F.col("__t"), F.col("__e")))
    return hit.groupBy("relation_id").agg(F.countDistinct("clause_id").alias("n"), F.min("clause_id").alias("clause_id")).filter("n = 1").drop("n")


def sample_ids(manifest: DataFrame, clauses: DataFrame) -> DataFrame:
    """Clauses of a sample list whose text is still the one that was sampled."""
    c = clauses.select("clause_id", F.sha2("raw_text", 256).alias("fingerprint"))
    return manifest.join(c, ["clause_id", "fingerprint"], "left_semi")


def match_context(matches: DataFrame, matters: DataFrame) -> DataFrame:
    """Each match with its first matter: the one of least id that holds one of its clauses.

    Arrays overlap where an element is equal, so the join is on elements and no pair is tried in vain.
    """
    m = matches.select("match_id", F.explode(F.array_distinct("clause_ids")).alias("c"))
    t = matters.select("matter_id", F.explode(F.array_distinct("clause_ids")).alias("c"))
    return m.join(t, "c").groupBy("match_id").agg(F.min("matter_id").alias("matter_id"))


def expand_candidates(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Candidates and up to six members of the matched matter that aren't among them, scored below the best."""
    best = candidates.agg(F.coalesce(F.max("score"), F.lit(0.1)).alias("top"))
    new = members.join(candidates.select("clause_id"), "clause_id", "left_anti").orderBy("sequence_no", "clause_id").limit(EXPANSION)
    more = new.crossJoin(F.broadcast(best)).select("clause_id", F.round(F.col("top") * EXPANSION_SHARE, 6).alias("score"), F.lit(True).alias("expanded"))
    return candidates.select("clause_id", "score", F.lit(False).alias("expanded")).unionByName(more)


def review_candidates(entities: DataFrame, relations: DataFrame, run: str, limit: int = 20) -> DataFrame:
    """Machine results of a run that people should see, entities before relations."""
    pick = lambda df, kind: df.filter((F.col("run_id") == run) & F.col("review_status").isin("pending", "auto_approved")).select(F.lit(kind).alias("kind"), "candidate_id", "review_status", "confidence")
    return pick(entities, "entity").unionByName(pick(relations, "relation")).orderBy(F.when(F.col("review_status") == "pending", 0).otherwise(1), "kind", "confidence", "candidate_id").limit(limit)


def matter_members(matters: DataFrame) -> DataFrame:
    """A row for each clause of a matter, with its place."""
    return matters.select("matter_id", F.posexplode("clause_ids").alias("sequence_no", "clause_id"))


def document_type_items(clauses: DataFrame) -> DataFrame:
    """clause_id, name, usage, category of list items that name a kind of document and what it is for."""
    parents = clauses.select(F.col("clause_id").alias("parent_clause_id"), F.col("raw_text").alias("__p"))
    c = clauses.filter("level = 'item'").join(parents, "parent_clause_id").filter(F.rlike("__p", F.lit(TYPE_PARENT)) & F.rlike("raw_text", F.lit(TYPE_ITEM)))
    return c.select("clause_id", strip(F.regexp_extract("raw_text", TYPE_ITEM, 1)).alias("name"), strip(F.regexp_extract("raw_text", TYPE_ITEM, 2)).alias("usage"), F.regexp_extract("__p", "学校公文种类|公文种类", 0).alias("category"))


def format_labels(labels: Column) -> Column:
    """Labels in their usual order and language, joined by an enumeration comma."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.array_contains(labels, k), F.lit(v)) for k, v in LABELS])), "、")


def parse_labels(text: Column) -> Column:
    """Codes of labels that a reviewer wrote; null if a word isn't a label or 'other' stands beside another."""
    parts = F.array_distinct(F.filter(F.split(text_or_blank(text), r"(?U)[、,，;；\s]+"), lambda p: p != ""))
    codes = F.array_compact(F.array(*[F.when(F.array_contains(parts, v), F.lit(k)) for k, v in LABELS]))
    good = (F.size(codes) == F.size(parts)) & ~(F.array_contains(codes, "other") & (F.size(codes) > 1))
    return F.when(good, codes)


def page_ranges(blocks: DataFrame, part: list[str], page: str) -> DataFrame:
    return blocks.groupBy(*part).agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The last successful run of each batch that wasn't a sample."""
    w = Window.partitionBy("batch_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.filter("status = 'succeeded' AND NOT is_sample").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
