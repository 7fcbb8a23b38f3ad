"""Searches of many queries against the one-query search of each."""

from pyspark.sql import functions as F

from docgrid.operators import retrieval as R


def test_every_query_has_its_own_list(spark):
    docs = spark.createDataFrame([(i, f"word{i % 5} word{i % 3} common text {'more ' * (i % 4)}") for i in range(40)], "doc_id long, text string")
    vecs = spark.createDataFrame([(i, [float(i % 7), float(i % 4), 1.0]) for i in range(60)] + [(60, None), (61, [1.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(0, "word1 word2 word1"), (20, "word4 more common"), (40, "nothing here")], "query_id long, query_text string")
    near = vecs.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    for search, table, queries in ((R.bm25, docs, asked), (R.vector_search, vecs, near)):
        got = sorted(tuple(r) for r in search(table, queries, 5).collect())
        want = []
        for i in (0, 20, 40):
            want += [(i, *r) for r in search(table, queries.filter(F.col("query_id") == i).drop("query_id"), 5).collect()]
        assert got == sorted(want) and len({r[0] for r in got}) > 1
