"""Review: label metrics, quality summaries, samples, annotations, and what reviewers see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.text import decision, strip
from docgrid.operators.staging import cut


def label_metrics(pairs: DataFrame, labels: list[str], predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """label, precision, recall, support from arrays of labels; 0 where there is nothing to divide."""
    each = pairs.select(predicted, actual, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    p, a = F.array_contains(predicted, F.col("label")), F.array_contains(actual, F.col("label"))
    g = each.groupBy("label").agg(F.count_if(p & a).alias("tp"), F.count_if(p).alias("said"), F.count_if(a).alias("support"))
    ratio = lambda x, y: F.coalesce(F.round(F.try_divide(F.col(x), F.col(y)), 6), F.lit(0.0))
    return g.select("label", ratio("tp", "said").alias("precision"), ratio("tp", "support").alias("recall"), "support")


def exact_match_rate(pairs: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    same = F.array_sort(F.array_distinct(predicted)) == F.array_sort(F.array_distinct(actual))
    return pairs.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(same.cast("double")), 6), F.lit(0.0)).alias("exact_match_rate"))


def quality_summary(rows: DataFrame, checks: list[str]) -> DataFrame:
    """reviewed (any check filled), fully_correct (all positive) and the negative answers of each check."""
    d = {c: decision(F.col(c)) for c in checks}
    filled, right = F.lit(False), F.lit(True)
    for v in d.values():
        filled, right = filled | v.isNotNull(), right & F.coalesce(v, F.lit(False))
    return rows.agg(F.count_if(filled).alias("reviewed"), F.count_if(right).alias("fully_correct"), *[F.count_if(~v).alias(f"{c}_errors") for c, v in d.items()])


def error_codes(rows: DataFrame, column: str) -> DataFrame:
    """code, n: codes separated by commas, semicolons or white space, upper-cased."""
    codes = rows.select(F.explode(F.split(F.upper(strip(F.col(column))), r"(?U)[,，;；\s]+")).alias("code")).filter("code <> ''")
    return codes.groupBy("code").agg(F.count("*").alias("n"))


def even_sample(rows: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """``limit`` evenly spaced rows of each group, first and last included: place round(p (n-1) / (limit-1)), half to even.

    Rows are dealt by ranges of group and order, and places are counts of the ranges before plus the place within, so a
    very large group is never one task.
    """
    keys = [F.col(group).alias("g"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)]]
    by = [f"o{k}" for k in range(len(order))]
    dealt = cut(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("rec"), *keys).repartitionByRange("g", *by).withColumn("part", F.spark_partition_id()))
    of = Window.partitionBy("g")
    counts = dealt.groupBy("g", "part").agg(F.count("*").alias("here"))
    counts = counts.select(F.col("g").alias("of"), F.col("part").alias("at"), F.sum("here").over(of).alias("n"), F.coalesce(F.sum("here").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    r = dealt.join(counts, (F.col("part") == F.col("at")) & F.col("g").eqNullSafe(F.col("of")))
    r = r.withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("g", "part").orderBy(*by)) - 1)
    # the wanted places of a group are at most ``limit``, listed in each row's group size
    places = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda p: F.bround(p * (F.col("n") - 1) / F.lit(max(limit - 1, 1))).cast("long"))
    return r.filter((F.col("n") <= limit) | F.array_contains(places, F.col("i"))).select("rec.*")


# Sample categories and the words that put a clause into them; None asks for a parent instead.
SAMPLE_CATEGORIES = (
    ("条件材料期限金额", "如果|符合|条件|材料|申请表|日内|期限|不超过|元|标准"), ("上下文与省略主体", None), ("多动作或许可禁止", "不得|禁止|可以|并|分别"),
    ("定义与适用范围", "是指|适用于|本办法所称|定义"), ("责任与动作", "应当|必须|负责|提交|审核|盘点|应"), ("补充覆盖", "."),
)


def balanced_sample(clauses: DataFrame, count: int = 20, categories: tuple = SAMPLE_CATEGORIES) -> DataFrame:
    """Up to ``count`` clauses, categories in turn, each time from the policy sampled least so far.

    ``clauses`` has policy_id, clause_id, parent_clause_id, sequence_no and raw_text.  The choice is greedy, but it can
    only ever take the first ``count`` clauses of a category from one of its first ``count`` policies, so Spark keeps
    those and the driver plays the choice on at most ``categories * count * count`` keys.
    """
    order = ["sequence_no", "clause_id"]
    c = clauses.withColumn("sequence_no", F.coalesce(F.col("sequence_no").cast("long"), F.lit(0)))
    meets = [(F.col("parent_clause_id").isNotNull() & (F.col("parent_clause_id") != "")) if p is None else F.rlike("raw_text", F.lit(p)) for _, p in categories]
    each = c.select("policy_id", *order, F.explode(F.array_compact(F.array(*[F.when(m, F.lit(k)) for k, m in enumerate(meets)]))).alias("k"))
    firsts = each.groupBy("k", "policy_id").agg(F.min(F.struct(*order)).alias("f"))
    some = firsts.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("policy_id"))).filter(F.col("n") <= count).select("k", "policy_id")
    kept = each.join(F.broadcast(some), ["k", "policy_id"]).withColumn("n", F.row_number().over(Window.partitionBy("k", "policy_id").orderBy(*order))).filter(F.col("n") <= count)
    pools: dict[int, list] = {}
    for r in kept.collect():
        pools.setdefault(r["k"], []).append((str(r["policy_id"]), r["sequence_no"], r["clause_id"]))
    used: dict[str, int] = {}
    seen: set = set()
    picked: list[tuple] = []
    while len(picked) < count:
        before = len(picked)
        for k, (reason, _) in enumerate(categories):
            free = [x for x in pools.get(k, ()) if x[2] not in seen]
            if free and len(picked) < count:
                policy, sequence, clause = min(free, key=lambda x: (used.get(x[0], 0), x))
                seen.add(clause)
                used[policy] = used.get(policy, 0) + 1
                picked.append((len(picked) + 1, clause, policy, reason))
        if len(picked) == before:
            break
    kind = clauses.schema["clause_id"].dataType.simpleString()
    return clauses.sparkSession.createDataFrame(picked, f"sample_no int, clause_id {kind}, policy_id string, reason string")


def latest_annotations(annotations: DataFrame) -> DataFrame:
    """The last decision on each candidate; additions, which have none before them, stay as they are."""
    added = annotations.filter("decision = 'added'")
    last = annotations.filter("decision <> 'added'").groupBy("candidate_id").agg(F.max_by(F.struct(*annotations.columns), F.struct("created_at", "annotation_id")).alias("r")).select("r.*")
    return last.unionByName(added)


def acceptance(rows: DataFrame, status: Column) -> DataFrame:
    """reviewed, accepted, accept_rate of reviewed rows."""
    r = rows.select(status.alias("s"))
    return r.agg(F.count_if(F.col("s").isin("approved", "corrected", "rejected")).alias("reviewed"), F.count_if(F.col("s").isin("approved", "corrected")).alias("accepted")).withColumn("accept_rate", F.coalesce(F.round(F.try_divide("accepted", "reviewed"), 6), F.lit(0.0)))


def review_rows(labels: DataFrame, clauses: DataFrame, documents: DataFrame) -> DataFrame:
    """Labels with their clause and document, in document order."""
    return labels.join(clauses, "clause_id").join(documents, "policy_id", "left").orderBy("policy_id", "sequence_no", "clause_id")
