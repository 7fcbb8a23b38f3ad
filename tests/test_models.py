"""Word segmentation against all segmentations, Variant documents against plain JSON, and polled services as a source."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrid.operators import retrieval, segmenter, variants
from docgrid.sources import polled

VOCABULARY = "学生 老师 图书馆 采购 管理 办法 申请 报销 审批 部门 学 生 会".split()


def cuts(run, longest):
    """All segmentations of a run into words of at most ``longest`` characters."""
    for at in itertools.product([False, True], repeat=len(run) - 1):
        words, begin = [], 0
        for k, yes in enumerate([*at, True], 1):
            if yes:
                words.append(run[begin:k])
                begin = k
        if all(len(w) <= longest for w in words):
            yield words


def weight(words, score):
    return sum(score.get(w, segmenter.UNSEEN if len(w) == 1 else -math.inf) for w in words)


def test_best_path_and_expectations_are_exact():
    of = random.Random(2)
    for _ in range(60):
        score = {w: -of.random() * 6 for w in {"".join(of.choice("甲乙丙") for _ in range(of.randrange(1, 4))) for _ in range(14)}}
        run = "".join(of.choice("甲乙丙丁") for _ in range(of.randrange(1, 10)))
        every = [(weight(c, score), c) for c in cuts(run, 3)]
        every = [(w, c) for w, c in every if w > -math.inf]
        best = max(every, key=lambda x: (round(x[0], 9), -len(x[1]), len(x[1][-1])))
        assert weight(segmenter.best_path(run, score, 3), score) == pytest.approx(best[0]) and "".join(segmenter.best_path(run, score, 3)) == run
        whole = sum(math.exp(w) for w, _ in every)
        want = {}
        for w, c in every:
            for word in c:
                want[word] = want.get(word, 0) + math.exp(w) / whole
        assert segmenter.expected(run, score, 3) == pytest.approx(want)
    assert segmenter.best_path("", {}) == [] and segmenter.best_path("生", {}) == ["生"]


def test_many_runs_at_once_are_as_one_by_one(monkeypatch):
    of = random.Random(3)
    monkeypatch.setattr(segmenter, "BLOCK", 300)
    for longest in (1, 3, 5):
        score = {w: -round(of.random() * 6, 1) for w in {"".join(of.choice("甲乙丙") for _ in range(of.randrange(1, longest + 1))) for _ in range(14)}}
        runs = ["".join(of.choice("甲乙丙丁") for _ in range(of.randrange(0, 40))) for _ in range(200)]
        lattices = segmenter.Lattices(score, longest)
        assert lattices.best(runs) == [segmenter.best_path(r, score, longest) for r in runs]
        times = [of.randrange(1, 9) for _ in runs]
        words, alone = lattices.expected(runs, np.array(times, float))
        want = {}
        for r, n in zip(runs, times, strict=True):
            for w, x in segmenter.expected(r, score, longest).items():
                want[w] = want.get(w, 0) + n * x
        got = {w: x for w, x in zip(lattices.words, words, strict=True) if x} | {chr(c): alone[c] for c in np.flatnonzero(alone)}
        assert got == pytest.approx(want)


def test_words_are_learned_and_searched(spark):
    of = random.Random(9)
    said = [[of.choice(VOCABULARY) for _ in range(of.randrange(4, 12))] for _ in range(400)]
    docs = spark.createDataFrame([(k, "".join(w) + f"。ABC{k} ") for k, w in enumerate(said)] + [(900, None), (901, "no such words")], "doc_id long, text string")
    score = segmenter.learn(docs, "text", words=10)
    tokens = segmenter.tokenizer(score)
    got = {r["doc_id"]: r["w"] for r in docs.select("doc_id", tokens(F.col("text")).alias("w")).collect()}
    assert got[900] == [] and got[901] == ["no", "such", "words"] and got[0][-1] == "abc0"

    def borders(words):
        return set(itertools.accumulate(map(len, words)))

    right = [len(borders(w) & borders(got[k][:-1])) / len(borders(w) | borders(got[k][:-1])) for k, w in enumerate(said)]
    assert sum(right) / len(right) > 0.85
    asked = spark.createDataFrame([("图书馆的采购",)], "query_text string")
    found = {r["doc_id"]: r["bm25_score"] for r in retrieval.bm25(docs, asked, 500, words=tokens).collect()}
    n, have = docs.count(), {k: set(w) for k, w in got.items()}
    wanted = segmenter.best_path("图书馆的采购", score)
    assert set(found) == {k for k, w in have.items() if w & set(wanted)}
    lengths, idf = {k: len(w) for k, w in got.items()}, {}
    vocabulary = {t for w in have.values() for t in w}
    for t in vocabulary:
        d = sum(t in w for w in have.values())
        idf[t] = math.log(n - d + 0.5) - math.log(d + 0.5)
    mean, average = sum(idf.values()) / len(idf), sum(lengths.values()) / n
    for k, s in found.items():
        tf = {t: got[k].count(t) for t in wanted}
        want = sum((0.25 * mean if idf.get(t, 0) < 0 else idf.get(t, 0)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * lengths[k] / average)) for t in wanted)
        assert s == pytest.approx(want, abs=2e-6)
    assert segmenter.learn(docs.limit(0)) == {}


def test_characters_that_are_hardly_ever_alone():
    of = random.Random(3)
    score = {"甲": -900.0, "乙": -250.0, "丙": -2.0, "甲乙": -3.0, "丙甲": -4.0, "乙丙乙": -5.0}
    runs = ["".join(of.choice("甲乙丙") for _ in range(of.randrange(1, 30))) for _ in range(100)]
    words, _ = segmenter.Lattices(score, 3).expected(runs, np.ones(100))
    want = {}
    for r in runs:
        for w, x in segmenter.expected(r, score, 3).items():
            want[w] = want.get(w, 0) + x
    assert dict(zip(segmenter.Lattices(score, 3).words, words, strict=True)) == pytest.approx(want | {"": 0, "乙丙": 0})


def test_substrings_are_counted_as_one_by_one():
    of = random.Random(5)
    runs = ["".join(of.choice("甲乙丙") for _ in range(of.randrange(0, 12))) for _ in range(50)]
    times, want = [of.randrange(1, 5) for _ in runs], {}
    for r, n in zip(runs, times, strict=True):
        for a, b in itertools.combinations(range(len(r) + 1), 2):
            if b - a <= 3:
                want[r[a:b]] = want.get(r[a:b], 0) + n
    assert {w: n for words, ns in segmenter.substrings(runs, np.array(times), 3) for w, n in zip(words, ns.tolist(), strict=True)} == want
    assert list(segmenter.substrings([], np.array([], np.int64), 3)) == []


def test_bm25_each_is_bm25_and_pairs_are_no_rows(spark, monkeypatch):
    of = random.Random(7)
    # copies, keys that occur again with texts of other lengths, nulls, and words that most documents have (a negative idf)
    docs = [(k % 450 if k % 50 else None, None if k % 70 == 3 else " ".join(of.choice(("la", f"w{of.randrange(60)}", "x y")) for _ in range(of.randrange(0, 12)))) for k in range(600)]
    docs = spark.createDataFrame(docs + [(1000 + k, "same text w1") for k in range(40)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(k, " ".join(f"w{of.randrange(80)}" for _ in range(6)) + " la la") for k in range(200)] + [(None, "w1 w2"), (900, None), (901, "unheard"), (902, "same text")], "query_id long, query_text string")
    want = {(r["query_id"], r["bm25_rank"]): r for r in retrieval.bm25(docs, asked, 5).collect()}
    for cells, rows in ((1 << 21, 4096), (300, 7)):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        monkeypatch.setattr(retrieval, "ROWS", rows)
        before = _shuffled(spark)
        found = retrieval.bm25_each(docs, asked, 5).collect()
        # 100,000 pairs share a term
        assert _shuffled(spark) - before < 40_000
        got = {(r["query_id"], r["bm25_rank"]): r for r in found}
        assert len(found) == len(got) == len(want) and {k: r["doc_id"] for k, r in got.items()} == {k: r["doc_id"] for k, r in want.items()}
        assert [got[k]["bm25_score"] for k in want] == pytest.approx([r["bm25_score"] for r in want.values()], abs=2e-6)
    assert retrieval.bm25_each(docs.limit(0), asked, 5).collect() == [] and retrieval.bm25_each(docs, asked.limit(0), 5).collect() == []


def _shuffled(spark) -> int:
    """Rows that shuffles have written so far."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_segmented_search_writes_no_row_for_each_pair(spark):
    from docgrid.plans.retrieval import AS_CJK

    text = "".join(AS_CJK[k % 26] for k in range(0, 90, 7))
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.substring(F.lit(AS_CJK), (F.col("id") % 26 + 1).cast("int"), F.lit(1))).alias("text"))
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    before = _shuffled(spark)
    found = retrieval.bm25_each(docs, asked, 10, words=segmenter.tokenizer(segmenter.learn(docs, words=20))).collect()
    assert len(found) == 1_000 and _shuffled(spark) - before < 50_000


DOCUMENTS = [(1, '{"a": {"b": 5, "c": "x"}, "n": null, "l": [1, "two", {"k": true}]}'), (2, '{"a": {"b": "5"}, "l": []}'), (3, '{"a": 7.5, "o k": 1}'), (4, "[1, 2]"), (5, "not json"), (6, None), (7, '{"a": {"b": 6.5}}')]


def test_variant_documents(spark):
    df = spark.createDataFrame(DOCUMENTS, "id long, text string").withColumn("v", variants.parsed(F.col("text"))).drop("text")
    met = lambda *a: sorted(r["id"] for r in df.filter(variants.where(F.col("v"), *a)).collect())
    assert met("$.a.b", "eq", 5) == [1] and met("$.a.b", "eq", "5") == [2] and met("$.a.b", "gt", 5) == [7] and met("$.a.b", "gte", 5.0) == [1, 7]
    assert met("$.a.b", "in", [5, 6.5]) == [1, 7] and met("$.a.b", "ne", 5) == [7] and met("$.a.b", "in", []) == []
    assert met("$.l[1]", "contains", "w") == [1] and met("$.l[2].k", "eq", True) == [1] and met("$['o k']", "lt", 2) == [3] and met("$.n", "exists") == [1] and met("$[1]", "eq", 2) == [4]
    for bad in ("a.b", "$.a[", "$..a"):
        with pytest.raises(ValueError):
            variants.where(F.col("v"), bad, "eq", 1)
    with pytest.raises(ValueError):
        variants.where(F.col("v"), "$.a", "like", 1)
    changes = spark.createDataFrame([(1, 9), (3, 8), (4, 1), (6, 2), (50, 3)], "id long, value int")
    got = {r["id"]: r["j"] and json.loads(r["j"]) for r in variants.upsert_at(df, changes, "id", "v", "$.a.b").select("id", F.to_json("v").alias("j")).collect()}
    assert got == {
        1: {"a": {"b": 9, "c": "x"}, "n": None, "l": [1, "two", {"k": True}]}, 2: {"a": {"b": "5"}, "l": []}, 3: {"a": {"b": 8}, "o k": 1}, 4: {"a": {"b": 1}}, 5: None, 6: {"a": {"b": 2}},
        7: {"a": {"b": 6.5}}, 50: {"a": {"b": 3}},
    }


class Service:
    """Tasks that are done when they were asked twice; what is asked is kept in a folder, as a service keeps it."""

    def __init__(self, folder):
        self.folder = folder

    def listing(self):
        import os

        return sorted(f for f in os.listdir(self.folder) if f.endswith(".in"))

    def submit(self, name):
        if "refused" in name:
            raise RuntimeError("refused")
        return name

    def status(self, task):
        import os

        if "slow" in task:
            return "running"
        if "bad" in task:
            return "failed"
        asked = f"{self.folder}/{task}.asked"
        if os.path.exists(asked):
            return "done"
        with open(asked, "w"):
            return "pending"

    def fetch(self, task):
        with open(f"{self.folder}/{task}") as f:
            return f.read().upper()


def test_polled_service_as_a_source(spark, tmp_path):
    polled.register(spark)
    Service.__module__ = "__main__"  # pickled by value
    for k in range(9):
        (tmp_path / f"f{k}.in").write_text(f"text {k}")
    for name in ("g_bad.in", "g_refused.in", "g_slow.in"):
        (tmp_path / name).write_text("x")
    read = spark.read.format(polled.NAME).option("service", polled.service_option(Service(str(tmp_path)))).option("per_partition", 4).option("every", 0.01).option("patience", 1)
    df = read.load()
    assert df.rdd.getNumPartitions() == 3
    rows = {r["name"]: r for r in df.collect()}
    assert len(rows) == 12 and rows["f3.in"]["content"] == "TEXT 3" and {rows[f"g_{k}.in"]["status"] for k in ("bad", "refused")} == {"failed"} and rows["g_slow.in"]["status"] == "timeout"
    with pytest.raises(Exception, match="service is needed"):
        spark.read.format(polled.NAME).load().collect()


def test_an_interrupted_stream_goes_on(spark, tmp_path):
    polled.register(spark)
    Service.__module__ = "__main__"
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    src.mkdir()

    def run():
        stream = spark.readStream.format(polled.NAME).option("service", polled.service_option(Service(str(src)))).option("per_partition", 2).option("every", 0.01).load()
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(mark)).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["name"] for r in spark.read.parquet(str(out)).collect())

    for k in range(3):
        (src / f"f{k}.in").write_text("a")
    assert run() == ["f0.in", "f1.in", "f2.in"]
    for k in range(3, 8):
        (src / f"f{k}.in").write_text("b")
    assert run() == [f"f{k}.in" for k in range(8)] and run() == [f"f{k}.in" for k in range(8)]
