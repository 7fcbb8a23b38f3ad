"""Every registered query of the subpackage over the smallest tables, those with SQL against DuckDB."""

import os
import zlib

import duckdb
import numpy as np
import pytest

from docgrid.llm import common, quality, queries

SF, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ("documents", "benchmark", "conversations", "pages", "labels")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def value(v):
    return round(v, 9) if isinstance(v, float) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    if name in queries.oracle_sql():
        rel = con.sql(queries.oracle_sql()[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows(df.columns, got) == rows(list(rel.columns), rel.fetchall())
    else:
        table, key = ("pages", "page_id") if name.startswith("op10") else ("documents", "doc_id")
        ids = [r[0] for r in con.sql(f"SELECT {key} FROM {table}").fetchall()]
        assert sorted(r[df.columns.index(key)] for r in got) == sorted(ids)


def test_quality_query_by_plain_python(spark):
    """The query learns from exactly the labelled rows that it may, and scores every row by the walked trees."""
    con = duckdb.connect()
    text = dict(con.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    out = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    learn = sorted((d, q) for d, q in set(con.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()) if d in text and not out(d))
    forest = quality.grow(np.array([quality.statistics(text[d]) for d, _ in learn]), np.array([float(q) for _, q in learn]))
    got = {r["doc_id"]: r for r in queries.op2_quality(spark, SF).collect()}
    for d, t in text.items():
        assert got[d]["held_out"] == out(d) and got[d]["score"] == pytest.approx(float(forest.score(np.array([quality.statistics(t)]))[0]))
        assert got[d]["predicted"] == (got[d]["score"] >= 0.5)


@pytest.mark.skipif(not os.path.isdir(MID), reason="the test tables aren't here")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    said = queries.op8_language(spark, MID).filter("held_out AND lang_pred <> 'und'").join(docs.select("doc_id", "lang").filter("lang IS NOT NULL"), "doc_id").collect()
    assert len(said) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in said]) > 0.97
    told = queries.op2_quality(spark, MID).filter("held_out").join(labels, "doc_id").collect()
    assert len(told) > 80 and np.mean([r["quality"] == r["predicted"] for r in told]) > 0.97


def test_a_cluster_needs_a_shared_folder():
    """Without spark.checkpoint.dir no folder of one machine is taken, unless there is one machine only."""

    class Option:
        def isDefined(self):
            return False

    class Spark:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

            class _jsc:
                sc = staticmethod(lambda: type("Sc", (), {"getCheckpointDir": staticmethod(Option)}))

    with pytest.raises(RuntimeError):
        common.shared_dir(Spark)
