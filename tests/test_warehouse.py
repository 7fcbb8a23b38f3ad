"""The versioned warehouse, the stored index, and searches and samples against plain Python over the tables."""

import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docgrid.operators import hierarchy, retrieval, review
from docgrid.plans import ledger, providers
from docgrid.session import Conflict, Session, Warehouse

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture
def house(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "w"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def files(house, name):
    return set(house._last(name)[1][1:])


def test_versions(spark, house):
    rows = lambda a, b: spark.range(a, b).selectExpr("id", "id % 3 AS part")
    house.write("t", rows(0, 3))
    first = files(house, "t")
    house.append("t", rows(3, 6))
    assert first < files(house, "t") and ids(house.read("t")) == list(range(6))
    house.delete("t", F.col("id") == 4)
    assert first < files(house, "t") and ids(house.read("t")) == [0, 1, 2, 3, 5]
    house.replace("t", F.col("part") == 0, rows(30, 31))
    assert ids(house.read("t")) == [1, 2, 5, 30]
    house.update("t", {"part": F.lit(9)}, F.col("id") == 30)
    assert {r["id"]: r["part"] for r in house.read("t").collect()} == {1: 1, 2: 2, 5: 2, 30: 9}
    house.delete("t", F.lit(True))
    assert ids(house.read("t")) == [] and house.read("t").columns == ["id", "part"]
    house.append("t", rows(7, 8))
    house.write("t", rows(7, 8))
    house.vacuum("t", 1)
    assert ids(house.read("t")) == [7] and len(house._list(f"{house.root}/t/versions")) == 1 and len(house._list(f"{house.root}/t/data")) == 1
    house.drop("t")
    assert not house.has("t")
    with pytest.raises(ValueError):
        house.read("t")


def test_two_writers(spark, house, monkeypatch):
    """Neither of two appends is lost, an expected version that isn't the last is refused, and a half-written one isn't read."""
    house.write("t", spark.range(1))
    other, last = Warehouse(spark, house.root), house._last("t")
    seen = [last, last]
    monkeypatch.setattr(house, "_last", lambda name: seen.pop() if seen else Warehouse._last(house, name))
    other.append("t", spark.range(10, 11))
    house.append("t", spark.range(20, 21))
    assert ids(other.read("t")) == [0, 10, 20]
    with pytest.raises(Conflict):
        other.write("t", spark.range(3), expected=last[0])
    number = f"{int(other.snapshot('t')) + 1:012d}"
    path, fs = other._file(f"{other.root}/t/versions/{number}")
    out = fs.create(path, False)
    out.write(bytearray(b"{}\n"))
    out.close()
    monkeypatch.setattr(Warehouse, "PATIENCE", 1)
    with pytest.raises(Conflict):
        other.read("t")
    other.vacuum("t")
    assert ids(other.read("t")) == [0, 10, 20]


def clauses_of(spark, rows):
    schema = "clause_id string, policy_id string, parent_clause_id string, search_text string, sequence_no int, level string, is_active boolean"
    return spark.createDataFrame([(c, p, None, t, k, "article", True) for k, (c, p, t) in enumerate(rows)], schema)


def test_index_runs(spark, house):
    """The stored index ranks as the direct search does, takes only what changed and drops what is gone."""
    rows = [(f"c{k}", f"p{k % 3}", f"common word w{k} {'extra ' * (k % 4)}") for k in range(12)]
    house.write("clauses", clauses_of(spark, rows))
    session = Session(house)
    made = lambda fresh: fresh.select("policy_id", "clause_id", F.array(F.lit(1.0), F.length("search_text").cast("double")).alias("embedding"))
    asked = spark.createDataFrame([("extra common w3 w4 none",)], "query_text string")

    def same():
        a = session.lexical.search(asked, 50)
        b = retrieval.bm25(house.read("clauses"), asked, 50, "clause_id", "search_text")
        assert [tuple(r) for r in a.orderBy("bm25_rank").collect()] == [tuple(r) for r in b.orderBy("bm25_rank").collect()]

    assert session.index_policies(made) == 3 and session.index_policies(made) == 0
    same()
    house.write("clauses", clauses_of(spark, [(c, p, t + " new" if p == "p1" else t) for c, p, t in rows if p != "p2"]))
    assert session.index_policies(made) == 2 and session.index_policies(made) == 0
    same()
    report = Session(house, embed=lambda text: 1 / 0).warm_up()
    assert report["lexical"]["status"] == "ready" and report["lexical"]["terms"] >= 12 and report["embedding"]["status"] == "failed"
    assert {r["policy_id"] for r in house.read("vectors").collect()} == {"p0", "p1"} and session.lexical.documents().select("item").distinct().count() == 2


def test_around_is_the_closure(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("x", "z"), ("z", "x"), *[(f"n{k}", f"n{k - 1}") for k in range(1, 80)]], "id string, parent_id string")
    pairs = hierarchy.closure(nodes)
    assert pairs.filter("descendant = 'n79'").count() == 79
    hits = spark.createDataFrame([("b",), ("z",), ("n40",)], "id string")
    want = sorted(map(tuple, pairs.join(hits, (F.col("id") == F.col("ancestor")) | (F.col("id") == F.col("descendant"))).select("ancestor", "descendant", "distance").distinct().collect()))
    assert sorted(map(tuple, hierarchy.around(hits, nodes, "id", "parent_id").collect())) == want


@tables
def test_hashed_search(spark):
    got = [(r["doc_id"], r["similarity"]) for r in providers.hashed_search(spark, SF).orderBy("vector_rank").collect()]
    con = duckdb.connect()

    def vector(text):
        v = np.zeros(64)
        for t in re.findall("[a-z0-9À-ɏ]+|[一-鿿]", (text or "").lower()):
            h = xxhash.xxh64_intdigest(t.encode(), 42)
            h -= (h >> 63) << 64
            v[h % 64] += 1 if h >> 40 & 1 else -1
        return v / max(math.sqrt((v * v).sum()), 1e-12)

    q = vector(con.sql(f"SELECT text FROM '{SF}/benchmark.parquet' WHERE item_id = 0").fetchall()[0][0])
    all_ = sorted(((round(float(vector(t) @ q / max(np.linalg.norm(vector(t)), 1e-12)), 6), -d) for d, t in con.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()), reverse=True)
    assert len(got) == 20
    assert [s for _, s in got] == pytest.approx([s for s, _ in all_[:20]], abs=2e-6)
    assert {d for d, s in got if s > got[-1][1] + 1e-5} == {-d for s, d in all_ if s > got[-1][1] + 1e-5}


@tables
def test_balanced_sample(spark):
    """Against the greedy choice from all rows."""
    rng = np.random.default_rng(4)
    rows = [(f"p{rng.integers(30):02d}", f"c{k}", "up" if k % 5 == 0 else None, int(rng.integers(100)), "".join(rng.choice(list("应当可以并如果定义xyz"), 6))) for k in range(800)]
    d = spark.createDataFrame(rows, "policy_id string, clause_id string, parent_clause_id string, sequence_no int, raw_text string")
    used, seen, want = Counter(), set(), []
    while len(want) < 20:
        before = len(want)
        for reason, pattern in review.SAMPLE_CATEGORIES:
            free = [r for r in rows if r[1] not in seen and (re.search(pattern, r[4]) if pattern else r[2])]
            if free and len(want) < 20:
                p, c, _, _, _ = min(free, key=lambda r: (used[r[0]], r[0], r[3], r[1]))
                seen.add(c)
                used[p] += 1
                want.append((len(want) + 1, c, p, reason))
        if len(want) == before:
            break
    assert sorted(map(tuple, review.balanced_sample(d).collect())) == want
    assert ledger.balanced_sample(spark, SF).count() == 20
