"""Extracted tables: parts as HTML tables, and the star schema as stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrid.operators import tables as T

from .common import made, table

#: Parts as tables with spans, with header cells, as forms, and nothing.
HTML = """SELECT p_partkey AS id, CASE p_partkey % 4
  WHEN 0 THEN '<table><tr><td rowspan="2">项目</td><td colspan="2">合计经费</td></tr><tr><td>预算经费</td><td>决算</td></tr><tr><td>' || p_name || '</td><td>28,003</td><td>1，' || (200 + p_size) || '</td></tr><tr><td>差旅</td><td>' || p_size || '</td><td></td></tr></table>'
  WHEN 1 THEN '<table><tr><th>Name</th><th>Name</th><th>A-B ' || p_brand || '</th></tr><tr><td>x</td><td>' || p_size || '.5</td><td>2024-01-05</td></tr></table>'
  WHEN 2 THEN '<table><tr><td>姓名</td><td>' || p_name || '</td></tr><tr><td>电话</td><td></td></tr></table>' ELSE '' END AS html FROM {part}"""


def _html(spark, sf_dir):
    return made(spark, sf_dir, HTML)


def table_headers(spark, sf_dir):
    s = T.structures(_html(spark, sf_dir), "id", "html")
    return s.select("id", F.array_join("headers", "; ").alias("headers"), F.size("rows").alias("n_rows"))


def table_cells(spark, sf_dir):
    cells = T.typed_cells(T.long_cells(T.structures(_html(spark, sf_dir), "id", "html"), "id"), ["id", "col_idx"])
    return cells.select("id", "row_idx", "col_idx", "data_type", T.coerce(F.col("value"), F.col("data_type")).alias("value"))


def table_column_keys(spark, sf_dir):
    s = T.structures(_html(spark, sf_dir), "id", "html").select("id", F.posexplode("headers").alias("ordinal", "label"))
    return T.column_keys(s, "id", "ordinal", "label")


def table_classes(spark, sf_dir):
    s = T.structures(_html(spark, sf_dir), "id", "html")
    return s.select("id", T.table_class(F.col("headers"), F.col("rows")).alias("category"))


def form_fields(spark, sf_dir):
    """Events as form rows: type, value, props; repeated types keep the last row."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("form"), F.col("event_id").alias("row"), F.array(F.col("event_type"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("")).alias("cells"))
    return T.form_fields(e, "form", "row", "cells")


def column_types(spark, sf_dir):
    """Columns of the lines as cells of text."""
    li = table(spark, sf_dir, "lineitem")
    names = ["l_orderkey", "l_quantity", "l_returnflag", "l_extendedprice"]
    cells = li.select(F.col("l_linenumber").alias("row_idx"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names], F.struct(F.lit("day").alias("name"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("value")), F.struct(F.lit("big").alias("name"), (F.col("l_partkey") * 10000000000).cast("string").alias("value")))).alias("c")).select("row_idx", "c.*")
    return T.infer_types(cells, ["name"])


FILTERS = [{"column": "l_returnflag", "operator": "equals", "value": "R"}, {"column": "l_quantity", "operator": "gte", "value": 10}, {"column": "l_discount", "operator": "lte", "value": 0.05}]
NAMES = [{"column": "p_type", "operator": "contains", "value": "st"}, {"column": "p_name", "operator": "contains", "value": "1_"}]


def table_filters(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.filter(T.compile_filters(li, FILTERS)).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def table_page(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return T.page(li.filter(T.compile_filters(li, FILTERS)), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 20, 40).select("l_orderkey", "l_linenumber", "l_partkey", "has_more")


def text_row_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 7 == 0, " cm").otherwise("")).alias("size"))
    return T.filter_text_rows(rows, [{"column": "p_type", "operator": "contains", "value": "ST"}, {"column": "size", "operator": "gte", "value": 30}])


def catalog_search(spark, sf_dir):
    return T.search_catalog(table(spark, sf_dir, "part"), "1%2", ["p_name", "p_brand", "p_type"], 30, ["p_partkey"]).select("p_partkey", "p_name")


def nearest_heading(spark, sf_dir):
    """System and assistant turns: an assistant's turn takes the user's turn before it, or else the next."""
    c = table(spark, sf_dir, "conversations")
    out = T.nearest_heading(c, ["conv_id"], "turn", F.col("role") == "assistant", F.when(F.col("role") == "user", F.col("text")))
    return out.select("conv_id", "turn", "heading")


def empty_cells(spark, sf_dir):
    s = T.parse_grids(_html(spark, sf_dir), "id", "html")
    return s.select("id", F.round(T.empty_ratio(F.flatten("grid")), 4).alias("empty_ratio"))


def table_identities(spark, sf_dir):
    """Parts' headings with a code before the title, without one and with one that is too short; codes have six digits, so
    parts from 900,000 on have none."""
    h = made(spark, sf_dir, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey < 900000 THEN ' X' || (100000 + p_partkey) || ' ' || p_name WHEN p_partkey % 3 < 2 THEN p_name ELSE 'X1' || p_size || ' ' || p_type END AS heading FROM {part}")
    code, title = T.table_identity(F.col("heading"))
    return h.select("p_partkey", code.alias("code"), title.alias("title"))


QUERIES = {f.__name__: f for f in (table_headers, table_cells, table_column_keys, table_classes, form_fields, column_types, table_filters, table_page, text_row_filters, catalog_search, nearest_heading, table_identities, empty_cells)}
_F = "l_returnflag = 'R' AND l_quantity >= 10 AND l_discount <= 0.05"
SQL = {
    "table_headers": "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '项目; 合计经费 / 预算经费; 合计经费 / 决算' WHEN 1 THEN 'Name; Name; A-B ' || p_brand WHEN 2 THEN '姓名; ' || p_name ELSE '' END AS headers, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS n_rows FROM part",
    "table_cells": """WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_name, p_size FROM part)
SELECT id, r AS row_idx, c AS col_idx, t AS data_type, v AS value FROM (
SELECT id, k, p_name, p_size, unnest([{'r': 0, 'c': 0, 't': 'TEXT', 'v': p_name}, {'r': 0, 'c': 1, 't': 'INTEGER', 'v': '28003'}, {'r': 0, 'c': 2, 't': 'INTEGER', 'v': '1' || (200 + p_size)}, {'r': 1, 'c': 0, 't': 'TEXT', 'v': '差旅'}, {'r': 1, 'c': 1, 't': 'INTEGER', 'v': '' || p_size}, {'r': 1, 'c': 2, 't': 'INTEGER', 'v': NULL}], recursive := true) FROM p WHERE k = 0
UNION ALL SELECT id, k, p_name, p_size, unnest([{'r': 0, 'c': 0, 't': 'TEXT', 'v': 'x'}, {'r': 0, 'c': 1, 't': 'DOUBLE PRECISION', 'v': p_size || '.5'}, {'r': 0, 'c': 2, 't': 'DATE', 'v': '2024-01-05'}], recursive := true) FROM p WHERE k = 1
UNION ALL SELECT id, k, p_name, p_size, unnest([{'r': 0, 'c': 0, 't': 'TEXT', 'v': '电话'}, {'r': 0, 'c': 1, 't': 'TEXT', 'v': NULL}], recursive := true) FROM p WHERE k = 2)""",
    "table_column_keys": """WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_name, p_brand FROM part)
SELECT id, CAST(o AS INTEGER) AS ordinal, label, key FROM (
SELECT id, unnest([0, 1, 2]) AS o, unnest(['项目', '合计经费 / 预算经费', '合计经费 / 决算']) AS label, unnest(['项目', '合计经费_预算经费', '合计经费_决算']) AS key FROM p WHERE k = 0
UNION ALL SELECT id, unnest([0, 1, 2]), unnest(['Name', 'Name', 'A-B ' || p_brand]), unnest(['name', 'name_2', 'a_b_' || lower(replace(p_brand, '#', '_'))]) FROM p WHERE k = 1
UNION ALL SELECT id, unnest([0, 1]), unnest(['姓名', p_name]), unnest(['姓名', replace(p_name, ' ', '_')]) FROM p WHERE k = 2)""",
    "table_classes": "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'data_table' WHEN 1 THEN 'uncertain' ELSE 'form' END AS category FROM part",
    "form_fields": """SELECT user_id AS form, event_type AS field, max_by(CASE WHEN event_id % 2 = 0 THEN event_id || ' | ' || props ELSE CAST(event_id AS VARCHAR) END, event_id) AS value
FROM events GROUP BY 1, 2""",
    "column_types": "SELECT * FROM (VALUES ('l_orderkey', 'INTEGER'), ('l_quantity', 'DOUBLE PRECISION'), ('l_returnflag', 'TEXT'), ('l_extendedprice', 'DOUBLE PRECISION'), ('day', 'DATE'), ('big', 'BIGINT')) t(name, data_type)",
    "table_filters": f"SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE {_F}",
    "table_page": f"""SELECT l_orderkey, l_linenumber, l_partkey, (SELECT count(*) > 60 FROM lineitem WHERE {_F}) AS has_more FROM lineitem WHERE {_F} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20 OFFSET 40""",
    "text_row_filters": "SELECT p_partkey, p_type, CAST(p_size AS VARCHAR) || CASE WHEN p_size % 7 = 0 THEN ' cm' ELSE '' END AS size FROM part WHERE contains(lower(p_type), 'st') AND p_size >= 30 AND p_size % 7 <> 0",
    "catalog_search": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%1%2%' OR p_brand ILIKE '%1%2%' OR p_type ILIKE '%1%2%' ORDER BY p_partkey LIMIT 30",
    "nearest_heading": """WITH h AS (SELECT *, CASE WHEN role = 'user' THEN text END AS h FROM conversations)
SELECT conv_id, turn, heading FROM (SELECT conv_id, turn, role, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
first_value(h IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS heading FROM h) WHERE role = 'assistant'""",
    "table_identities": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey < 900000 THEN 'X' || (100000 + p_partkey) ELSE '' END AS code, CASE p_partkey % 3 WHEN 2 THEN 'X1' || p_size || ' ' || p_type ELSE p_name END AS title FROM part",
    "empty_cells": "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 0.0833::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS empty_ratio FROM part",
}
