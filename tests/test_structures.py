"""Interval labels against the closure, sweeps against all pairs, stored lookup keys against the direct search."""

import random
import time

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from docgrid.operators import governance, hierarchy, intervals, sweeps
from docgrid.plans import common

TREE = [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", "gone"), ("f", "e"), ("x", "z"), ("y", "x"), ("z", "y"), ("u", "y"), ("v", "u"), ("self", "self"), ("under", "self"), ("alone", None)]


def forest(spark):
    of = random.Random(3)
    more = [(f"r{k:03d}", f"r{of.randrange(max(0, k - 6), k):03d}" if k else None) for k in range(120)] + [(f"w{k}", "a") for k in range(60)] + [(f"l{k}", f"l{k - 1}") for k in range(1, 70)]
    return spark.createDataFrame(TREE + more, "id string, parent_id string")


def test_labels_are_the_closure(spark, monkeypatch):
    """Forests with cycles, tails of cycles, orphans, a wide node and a long chain; few hits are sent around, many are met by blocks."""
    nodes = forest(spark)
    told = intervals.labels(nodes).cache()
    assert told.count() == nodes.select("id").union(nodes.select("parent_id")).distinct().filter("id IS NOT NULL").count()
    want = sorted(map(tuple, hierarchy.closure(nodes).collect()))
    for few in (10_000, 0):
        monkeypatch.setattr(intervals, "FEW", few)
        assert sorted(map(tuple, intervals.pairs(told, told).collect())) == want
    hits = spark.createDataFrame([("b",), ("z",), ("l40",), ("under",), ("nobody",)], "id string")
    near = sorted((a, d, n) for a, d, n in want if {a, d} & {"b", "z", "l40", "under"})
    assert sorted(map(tuple, intervals.around(told, hits).collect())) == near


def test_labels_follow_the_order(spark):
    rows = [("top", None, 1), ("second", "top", 2), ("first", "top", 1), ("none", "top", None), ("under", "second", 1)]
    told = {r["id"]: r for r in intervals.labels(spark.createDataFrame(rows, "id string, up string, o int"), "id", "up", "o").collect()}
    assert sorted(told, key=lambda i: told[i]["pre"]) == ["top", "none", "first", "second", "under"] and [told[i]["depth"] for i in ("top", "first", "under")] == [0, 1, 2]
    assert intervals.labels(spark.createDataFrame([], "id string, parent_id string")).count() == 0


def brute_overlaps(rows):
    out = []
    for k, (f, a, s, e) in enumerate(rows):
        for g, b, t, u in rows[k + 1 :]:
            if f is not None and f == g and a != b and s is not None and t is not None and (u is None or s < u) and (e is None or t < e):
                out.append((f, *sorted((a, b))))
    return sorted(out)


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_sweep_is_all_pairs(spark, size):
    of = random.Random(size)
    rows = []
    for k in range(160):
        s = of.choice([None, *range(60)]) if k % 9 == 0 else of.randrange(60)
        rows.append((of.choice(["p", "p", "p", "q", None]), f"v{k:03d}", s, None if s is None or k % 13 == 0 else s + of.randrange(-2, 12)))
    df = spark.createDataFrame(rows, "f string, id string, s long, e long")
    assert sorted(map(tuple, sweeps.overlaps(df, "f", "id", "s", "e", size).collect())) == brute_overlaps(rows)
    days = df.select("f", "id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("s").cast("int")).alias("s"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("e").cast("int")).alias("e"))
    assert sorted(map(tuple, governance.family_overlaps(days, "f", "id", "s", "e").collect())) == brute_overlaps(rows)


def test_a_large_family_is_linear(spark):
    rows = spark.range(200_000).select(F.lit("f").alias("f"), "id", (F.col("id") * 10).alias("s"), (F.col("id") * 10 + F.when(F.col("id") % 50_000 == 1, 11).otherwise(9)).alias("e"))
    began = time.time()
    assert sorted((r[1], r[2]) for r in sweeps.overlaps(rows, "f", "id", "s", "e", 5_000).collect()) == [(1, 2), (50_001, 50_002), (100_001, 100_002), (150_001, 150_002)]
    assert time.time() - began < 60


def test_stored_keys_join_without_a_shuffle(spark):
    docs = spark.createDataFrame([("p1", "校发〔2020〕1号", "旧办法", None), ("p2", None, "旧办法", "2021-01-01"), ("p3", None, "另一办法", "2022-05-01"), ("p4", None, None, None)], "policy_id string, doc_number string, title string, issue_date string").withColumn("issue_date", F.col("issue_date").cast("date"))
    rel = spark.createDataFrame([("r1", "p9", "旧办法", None, None), ("r2", "p2", "旧办法", None, None), ("r3", "p9", "旧办法", None, 2021), ("r4", "p9", "随便", "校发[2020]1号", None), ("r5", "p3", "另一办法", None, None), ("r6", "p9", "另一办法", None, 1999)], "relation_id string, source_policy_id string, target_title string, target_doc_number string, target_year int")
    want = {"r1": None, "r2": "p1", "r3": "p2", "r4": "p1", "r5": None, "r6": None}
    assert {r[0]: r[1] for r in governance.resolve_targets(rel, docs).collect()} == want
    governance.store_keys(governance.target_keys(docs), "target_keys", 4)
    governance.store_keys(governance.wanted_keys(rel), "wanted_keys", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = governance.matched(spark.table("wanted_keys"), spark.table("target_keys"))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and {r[0]: r[1] for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE target_keys")
        spark.sql("DROP TABLE wanted_keys")


def test_many_documents_of_one_title(spark):
    docs = spark.range(100_000).select(F.concat(F.lit("p"), "id").alias("policy_id"), F.lit(None).cast("string").alias("doc_number"), F.lit("通知").alias("title"), F.lit(None).cast("date").alias("issue_date"))
    rel = spark.range(20_000).select(F.concat(F.lit("r"), "id").alias("relation_id"), F.lit("p1").alias("source_policy_id"), F.lit("通知").alias("target_title"), F.lit(None).cast("string").alias("target_doc_number"), F.lit(None).cast("int").alias("target_year"))
    began = time.time()
    assert governance.resolve_targets(rel, docs).filter("target_policy_id IS NULL").count() == 20_000 and time.time() - began < 30


def test_clauses_stream_over_batches():
    columns = ["policy_id", "sequence_no", "slot", "label", "numbered"]
    rows = [(1, 1, hierarchy.ARTICLE, "第1条", False), (1, 2, hierarchy.PARAGRAPH + 2, "（一）", False), (2, 1, hierarchy.PARAGRAPH + 2, "（一）", True), (2, 2, hierarchy.PARAGRAPH + 3, "1.", True)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], columns) for part in (rows[:1], rows[1:3], rows[3:])]
    got = [r for b in hierarchy._stacked(iter(batches)) for r in b.select(["policy_id", "sequence_no", "parent_no", "article_no"]).to_pylist()]
    assert [tuple(r.values()) for r in got] == [(1, 1, None, "1"), (1, 2, 1, "1"), (2, 1, None, ""), (2, 2, 1, "")]


def test_narrow_tables_are_dealt(spark, tmp_path):
    spark.range(100).selectExpr("id AS p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = common.made(spark, str(tmp_path), "SELECT p_partkey FROM {part}")
    full = made.rdd.glom().map(len).filter(lambda n: n > 0).count()
    assert full > 1 and made.count() == 100
