"""The index of segments against the direct search after every update, and the inverted file against exact search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrid.operators import retrieval, segments, vectors
from docgrid.operators.segments import SegmentIndex, tier
from docgrid.session import Warehouse


@pytest.fixture
def house(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "w"))


def docs_of(spark, rows):
    return spark.createDataFrame([(k, p, t) for k, (p, t) in rows.items()], "clause_id string, policy_id string, search_text string")


def files(house, part):
    return set(house._last(f"lexical_{part}")[1][1:])


QUERIES = [(0, "w1 w2 common common"), (20, "w7 nothing w3"), (40, "absent"), (60, "common extra")]


def same(spark, index, rows):
    """The index and the direct search rank alike, for one query and for many."""
    docs = docs_of(spark, rows)
    asked = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    got = sorted(map(tuple, index.search(asked, 30).collect()))
    assert got == sorted(map(tuple, retrieval.bm25(docs, asked, 30, "clause_id", "search_text").select("query_id", "clause_id", "bm25_score", "bm25_rank").collect()))
    one = asked.filter("query_id = 0").drop("query_id")
    assert sorted(map(tuple, index.search(one, 5).collect())) == sorted(map(tuple, retrieval.bm25(docs, one, 5, "clause_id", "search_text").collect()))


def text(of):
    return " ".join([f"w{of.randrange(12)}" for _ in range(of.randrange(1, 9))] + ["common"] * of.randrange(3) + ["extra"] * of.randrange(2))


def test_updates_leave_older_files(spark, house):
    of = random.Random(1)
    rows = {f"c{k}": (f"p{k % 5}", text(of)) for k in range(40)}
    index = SegmentIndex(house)
    first = index.update(docs_of(spark, rows), "r1", "2024-01-01 00:00:00")
    assert first["status"] == "succeeded" and first["items"] == 5
    same(spark, index, rows)
    for step in range(2, 7):
        had = {part: files(house, part) for part in ("postings", "docs", "counts")}
        if step == 4:
            for k in [k for k, (p, _) in rows.items() if p == "p4"]:
                del rows[k]
        elif step == 5:
            rows |= {f"n{k}": ("p9", text(of)) for k in range(7)} | {"n8": ("p9", None), "n9": ("p9", "?!")}
        else:
            rows["c1"] = ("p1", text(of) + f" new{step}")
        run = index.update(docs_of(spark, rows), f"r{step}", "2024-01-02 00:00:00")
        assert run["status"] == "succeeded" and run["items"] == 1
        assert all(had[part] <= files(house, part) for part in had)
        items = {r["item"]: r for r in index.items(f"r{step}").collect()}
        assert len(items) == 1 and (step != 4 or (items["p4"]["status"], items["p4"]["gone"]) == ("skipped", 8))
        same(spark, index, rows)
    before = {part: files(house, part) for part in ("postings", "docs", "counts")}
    assert index.update(docs_of(spark, rows), "r7", "2024-01-03 00:00:00")["items"] == 0 and {part: files(house, part) for part in before} == before
    assert {r["run_id"]: r["status"] for r in index.runs().collect()} == {f"r{k}": "succeeded" for k in range(1, 8)}
    went = index.compact()
    assert len(went) >= 4 and len(index.manifest()) < 6
    same(spark, index, rows)
    rows["c2"] = ("p2", "common after compaction")
    index.update(docs_of(spark, rows), "r8", "2024-01-04 00:00:00")
    same(spark, index, rows)
    index.sweep()
    same(spark, index, rows)
    rows["c2"] = ("p2", "w1 w2 after the sweep")
    rows.pop("c3")
    index.update(docs_of(spark, rows), "r9", "2024-01-05 00:00:00")
    same(spark, index, rows)
    assert index.documents().count() == len(rows)


def test_failed_and_stopped_runs(spark, house, monkeypatch):
    """Items that are refused keep what they had; what a run that died has written isn't seen, and the next one goes on."""
    rows = {"a": ("p", "common w1"), "b": ("q", "w2 common")}
    index = SegmentIndex(house)
    index.update(docs_of(spark, rows), "r1", "2024-01-01 00:00:00")
    old = dict(rows)
    rows |= {"a": ("p", "w3 changed"), "b": ("q", "w7 changed"), "c": ("q", "w1")}
    bad = lambda items: items.filter("item = 'q'").withColumn("error", F.lit("no model"))
    run = index.update(docs_of(spark, rows), "r2", "2024-01-01 00:00:00", check=bad)
    assert (run["status"], run["done"], run["failed"]) == ("failed", 1, 1)
    assert {r["item"]: (r["status"], r["error"]) for r in index.items("r2").collect()} == {"p": ("succeeded", ""), "q": ("failed", "no model")}
    same(spark, index, {"a": rows["a"], "b": old["b"]})
    assert index.update(docs_of(spark, rows), "r2", "2024-01-01 00:00:00")["status"] == "failed"

    def dies(*a):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(index, "_publish", dies)
    with pytest.raises(RuntimeError):
        index.update(docs_of(spark, rows), "r3", "2024-01-02 00:00:00")
    monkeypatch.undo()
    assert index.runs().filter("run_id = 'r3'").first()["status"] == "running"
    same(spark, index, {"a": rows["a"], "b": old["b"]})
    assert index.update(docs_of(spark, rows), "r3", "2024-01-02 00:00:00")["status"] == "running"
    assert index.update(docs_of(spark, rows), "r3", "2024-01-02 00:00:00", resume=True)["status"] == "succeeded"
    same(spark, index, rows)
    index.sweep()
    same(spark, index, rows)


def test_postings_are_blocks(spark, house, monkeypatch):
    """A term is one row with all documents of a block, and blocks, runs of tokens and files that are small change no result."""
    of = random.Random(3)
    rows = {f"c{k:02}": (f"p{k % 5}", text(of)) for k in range(40)} | {"c40": ("p1", "common " * 30 + "w1 w2 w1"), "c41": ("p2", None), "c42": ("p2", "?!")}
    index = SegmentIndex(house)
    index.update(docs_of(spark, rows).coalesce(1), "r1", "2024-01-01 00:00:00")
    want = {}
    for k, (_, words) in rows.items():
        for w in set((words or "").replace("?!", "").split()):
            want.setdefault(w, set()).add(k)
    post = house.read("lexical_postings")
    assert post.agg(F.sum("n")).first()[0] == index.manifest()[0]["postings"] == sum(map(len, want.values()))
    # as many rows as blocks have terms, not as documents have
    blocks = len(files(house, "docs"))
    assert post.count() <= blocks * len(want) < sum(map(len, want.values()))
    got = {}
    for r in post.collect():
        assert len(r["keys"]) == len(r["occurs"]) == len(r["lengths"]) == r["n"]
        got.setdefault(r["term"], []).extend(r["keys"])
        if "c40" in r["keys"]:
            at = r["keys"].index("c40")
            assert (r["occurs"][at], r["lengths"][at]) == ({"common": 30, "w1": 2, "w2": 1}[r["term"]], 33)
    assert {t: set(k) for t, k in got.items()} == want and sum(map(len, got.values())) == sum(map(len, want.values()))
    same(spark, index, rows)
    monkeypatch.setattr(segments, "TOKENS", 7)
    monkeypatch.setattr(segments, "PAIRS", 5)
    monkeypatch.setattr(segments, "PART", 20)
    rows |= {f"c{k:02}": ("p3", text(of) + " fresh") for k in range(20, 60)}
    index.update(docs_of(spark, rows), "r2", "2024-01-02 00:00:00")
    assert index.manifest()[-1]["postings"] > house.read("lexical_postings").filter("segment = 2").filter("term = 'fresh'").count() > 1
    same(spark, index, rows)


def test_no_index_and_no_documents(spark, house):
    index = SegmentIndex(house)
    asked = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    assert index.search(asked).count() == 0 and index.compact() == []
    assert index.update(docs_of(spark, {"a": ("p", "w1")}).limit(0), "r1", "2024-01-01 00:00:00")["items"] == 0
    assert index.search(asked).count() == 0


def test_tiers():
    assert [tier(n) for n in (0, 3, 4, 15, 16, 64)] == [0, 0, 1, 1, 2, 3]


def points(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    return [(i, (centres[rng.integers(12) if i % 3 else 0] + 0.3 * rng.normal(size=8)).tolist()) for i in range(n)]


def test_inverted_file(spark, house, monkeypatch):
    rows = [*points(1500, 3), (2000, None), (2001, [1.0]), (2002, [float("nan")] * 8), (2003, [0.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = table.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = vectors.search_exact(table.filter("vec_id < 2000"), asked.filter("query_id < 2000"), 10)
    want = retrieval.vector_search(table.filter("vec_id < 2000"), asked.filter("query_id < 2000"), 10)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, want.collect()))
    index = vectors.InvertedFile(house)
    assert index.build(table) == 39
    found = index.search(asked.filter("query_id < 2000"), 10)
    assert vectors.recall(found, exact) >= 0.9
    assert sorted(map(tuple, index.search(asked.filter("query_id < 2000"), 10, probes=39).collect())) == sorted(map(tuple, exact.collect()))
    # small parts and blocks, so that a hot cell and the queries come in many
    monkeypatch.setattr(vectors, "PART", 100)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert sorted(map(tuple, vectors.search_exact(table, asked.filter("query_id < 2000"), 10).filter("vec_id < 2000").collect())) == sorted(map(tuple, exact.collect()))
    assert sorted(map(tuple, index.search(asked.filter("query_id < 2000"), 10, probes=39).collect())) == sorted(map(tuple, exact.collect()))


def test_inverted_file_reads_its_cells_alone(spark, house):
    table = spark.createDataFrame(points(600, 5), "vec_id long, embedding array<float>")
    index = vectors.InvertedFile(house)
    index.build(table, cells=12)
    plan = spark.read.parquet(index._data).filter(F.col("cell").isin([3]))
    assert "PartitionFilters: [isnotnull(cell" in plan._jdf.queryExecution().toString()
    assert all("/cell=3/" in r[0] for r in plan.select(F.col("_metadata.file_path")).distinct().collect())
    with pytest.raises(ValueError):
        vectors.InvertedFile(house, "none").build(table.limit(0))
