"""Extracted tables: grids, headers, types, catalog, forms and typed filters."""

from __future__ import annotations

import json
from functools import reduce
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from docgrid.functions.text import squash, strip

# Keywords of table classes, date forms of cells.
TOTAL_WORDS = ("合计", "小计", "总计", "平均", "总和", "汇总")
HEADER_WORDS = (
    "学号", "姓名", "编号", "序号", "日期", "时间", "金额", "数量", "成绩", "分数", "部门", "单位",
    "年级", "班级", "专业", "课程", "代码", "名称", "类型", "状态", "备注", "说明", "地址", "电话",
)
FORM_WORDS = ("签名", "签章", "审批意见", "审批", "意见", "说明", "申请理由", "承诺", "声明", "照片", "粘贴处", "贴照片", "盖章")
DATE_CELL = r"^(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2}|\d{4}年\d{1,2}月\d{1,2}日)$"
SAMPLE_ROWS = 20
HIDDEN = ("_row_id", "_page_num", "_row_idx")


# The largest spans that HTML knows.
ROWSPAN, COLSPAN = 65_534, 1_000


class _Cells(HTMLParser):
    """Rows of cells (text, is header, rowspan, colspan) of the first table."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[list]] = []
        self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            a = dict(attrs)
            self.rows = self.rows or [[]]
            self.cell = ["", tag == "th", span(a.get("rowspan"), ROWSPAN), span(a.get("colspan"), COLSPAN)]
            self.rows[-1].append(self.cell)
        elif tag == "br" and self.cell:
            self.cell[0] += " "

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell:
            self.cell[0] += data


def span(value, most: int = ROWSPAN) -> int:
    """A span attribute: at least one, junk is one, and at most what HTML allows."""
    try:
        return min(most, max(1, int(str(value).strip())))
    except (TypeError, ValueError):
        return 1


def expand(html: str) -> tuple[list[list[str]], list[list[bool]]]:
    """The rectangular grid of a table and the mask of its header cells; spans repeat their cell."""
    p = _Cells()
    p.feed(html or "")
    taken: dict[tuple[int, int], tuple[str, bool]] = {}
    for r, row in enumerate(p.rows):
        c = 0
        for text, head, rows, cols in row:
            while (r, c) in taken:
                c += 1
            for i in range(r, min(r + rows, len(p.rows))):
                for j in range(c, c + cols):
                    taken.setdefault((i, j), (" ".join(text.split()), head))
            c += cols
    width = max((c + 1 for _, c in taken), default=0)
    grid = [[taken.get((r, c), ("", False)) for c in range(width)] for r in range(len(p.rows))]
    return [[t for t, _ in row] for row in grid], [[h for _, h in row] for row in grid]


def parse_grids(tables: DataFrame, key: str, html: str) -> DataFrame:
    """key, grid array<array<string>>, mask array<array<boolean>>, by Arrow batches."""
    import pyarrow as pa

    kind = tables.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [expand(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g for g, _ in got], pa.list_(pa.list_(pa.string()))), pa.array([m for _, m in got], pa.list_(pa.list_(pa.bool_())))], [key, "grid", "mask"])

    return tables.select(key, html).mapInArrow(run, f"`{key}` {kind}, grid array<array<string>>, mask array<array<boolean>>")


def is_number(cell: Column) -> Column:
    return F.regexp_replace(strip(cell), "[,，]", "").rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)%?$")


def is_data_row(row: Column) -> Column:
    """At least half of the non-empty cells (and one) are numbers."""
    full = F.size(F.filter(row, lambda c: strip(c) != ""))
    return F.size(F.filter(row, is_number)) >= F.greatest(F.lit(1), F.floor(full / 2))


def header_rows(grid: Column, mask: Column) -> Column:
    """How many leading rows are header: those with a header cell, else those before the first data row, else one."""
    index = lambda a, test: F.coalesce(F.array_position(F.transform(a, test), True) - 1, F.lit(-1))
    plain = index(mask, lambda m: ~F.exists(m, lambda x: x))
    marked = F.when(plain < 0, F.size(mask)).otherwise(plain)
    data = index(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(1))), is_data_row)
    return F.when(F.size(grid) == 0, 0).when(marked > 0, marked).when(data >= 0, data + 1).when(F.size(grid) > 1, 1).otherwise(0).cast("int")


def header_paths(grid: Column, n: Column) -> Column:
    """Column names: the different texts of a column's header rows, joined by ' / '."""
    head = F.slice(grid, 1, n)

    def path(c: Column) -> Column:
        cells = F.filter(F.transform(head, lambda r: F.get(r, c)), lambda t: t != "")
        kept = F.filter(cells, lambda t, i: (i == 0) | (t != F.get(cells, i - 1)))
        return F.array_join(kept, " / ")

    width = F.coalesce(F.size(F.get(grid, F.lit(0))), F.lit(0))
    return F.when((n > 0) & (width > 0), F.transform(F.sequence(F.lit(0), width - 1), path)).otherwise(F.array().cast("array<string>"))


def structures(tables: DataFrame, key: str, html: str) -> DataFrame:
    """key, headers, rows of HTML tables."""
    g = parse_grids(tables, key, html).withColumn("n", header_rows(F.col("grid"), F.col("mask")))
    rows = F.when(F.size("grid") > F.col("n"), F.slice("grid", F.col("n") + 1, F.size("grid"))).otherwise(F.array().cast("array<array<string>>"))
    return g.select(key, header_paths(F.col("grid"), F.col("n")).alias("headers"), rows.alias("rows"))


def long_cells(structure: DataFrame, key: str) -> DataFrame:
    """A row for each cell: key, row_idx, col_idx, value."""
    r = structure.select(key, F.posexplode("rows").alias("row_idx", "cells"))
    return r.select(key, "row_idx", F.posexplode("cells").alias("col_idx", "value"))


def plain_number(value: Column) -> Column:
    return F.regexp_replace(strip(value), "[,，]", "")


def _told(cells: DataFrame, value: str, row: str, sample: int) -> DataFrame:
    """``cells`` with what the type of a column is told by: v, said, whole and n, null where a cell tells nothing."""
    v = F.when(F.col(row) < sample, plain_number(F.col(value)))
    c = cells.withColumn("v", F.when(v != "", v)).withColumn("said", F.col(value))
    c = c.withColumn("whole", F.col("v").rlike(r"^[-+]?\d+$"))
    # only whole numbers are cast, as a cast that fails costs far more than a match
    return c.withColumn("n", F.when(F.col("whole"), F.expr("try_cast(v AS bigint)")))


def _tests() -> dict[str, Column]:
    """Aggregates over the cells of a column from ``_told``: cells that tell nothing are null and count for no test."""
    some = lambda test: F.bool_and(F.when(F.col("v").isNotNull(), test))
    real = F.col("whole") | F.col("v").rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$")
    return {
        "whole": F.bool_and("whole"), "i32": some(F.col("n").isNotNull() & F.col("n").between(-(1 << 31), (1 << 31) - 1)), "i64": some(F.col("n").isNotNull()),
        "real": some(real), "day": some(strip(F.col("said")).rlike(DATE_CELL)),
    }


def _kind(of: str = "") -> Column:
    c = lambda name: F.col(of + name)
    kind = F.when(c("i32"), "INTEGER").when(c("i64"), "BIGINT").when(c("whole"), "TEXT").when(c("real"), "DOUBLE PRECISION").when(c("day"), "DATE").otherwise("TEXT")
    return F.coalesce(kind, F.lit("TEXT")).alias("data_type")


def infer_types(cells: DataFrame, by: list[str], value: str = "value", row: str = "row_idx", sample: int = SAMPLE_ROWS) -> DataFrame:
    """The type of each column from its first ``sample`` rows: INTEGER, BIGINT, DOUBLE PRECISION, DATE or TEXT."""
    # one pass: cells that tell nothing are null and count for no test, but their columns are there
    g = _told(cells.select(*by, value, row), value, row, sample).groupBy(*by).agg(*[c.alias(n) for n, c in _tests().items()])
    return g.select(*by, _kind())


def typed_cells(cells: DataFrame, by: list[str], value: str = "value", row: str = "row_idx", sample: int = SAMPLE_ROWS) -> DataFrame:
    """``cells`` with the type of their column, as ``infer_types`` tells it.

    The types meet the cells in one shuffle and not in a join, so that what gives the cells (a parser) runs once.  It is for
    columns of extracted tables, of which each was a row before; stored tables of any size are for ``infer_types``.
    """
    w = Window.partitionBy(*by)
    told = _told(cells, value, row, sample)
    return told.select(*[F.col(c) for c in cells.columns], F.struct(*[c.over(w).alias(n) for n, c in _tests().items()]).alias("__t")).select(*cells.columns, _kind("__t."))


def coerce(value: Column, data_type: Column) -> Column:
    """Cell text as it is stored: blank is null, numbers lose their separators, what isn't a number is null."""
    v = plain_number(value)
    text = F.when(strip(value) == "", None).otherwise(strip(value))
    return F.when(data_type.isin("INTEGER", "BIGINT"), v.try_cast("bigint").cast("string")).when(data_type == "DOUBLE PRECISION", v.try_cast("double").cast("string")).otherwise(text)


def column_keys(names: DataFrame, table: str, ordinal: str, label: str) -> DataFrame:
    """table, ordinal, label, key: names of word characters, those that repeat get _2, _3 and so on."""
    k = F.regexp_replace(F.regexp_replace(F.lower(strip(F.col(label))), r"(?U)[^\w\x{4e00}-\x{9fff}]+", "_"), "_+", "_")
    k = F.regexp_replace(k, "^_+|_+$", "")
    k = F.when(k == "", "col_unknown").otherwise(k)
    n = names.withColumn("__k", k).withColumn("__n", F.row_number().over(Window.partitionBy(table, "__k").orderBy(ordinal)))
    return n.select(table, ordinal, label, F.when(F.col("__n") == 1, F.col("__k")).otherwise(F.concat_ws("_", "__k", F.col("__n").cast("string"))).alias("key"))


def table_class(headers: Column, rows: Column) -> Column:
    """data_table, form or uncertain by the sum of what speaks for a data table."""
    cells = F.flatten(F.concat(F.array(headers), rows))
    names = F.array_join(headers, "")
    has = lambda words: F.exists(cells, lambda c: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words]))
    empty = F.size(F.filter(cells, lambda c: strip(c) == "")) / F.greatest(F.size(cells), F.lit(1))
    score = F.when(F.size(headers) >= 3, 2).otherwise(-2) + F.when(F.size(rows) >= 5, 2).otherwise(-2) + F.when(names.rlike("|".join(HEADER_WORDS)), 2).otherwise(0) + F.when(has(TOTAL_WORDS), 3).otherwise(0) - F.when(has(FORM_WORDS), 2).otherwise(0)
    return F.when(empty >= 0.5, "form").when(score > 0, "data_table").when(score < 0, "form").otherwise("uncertain")


def form_fields(rows: DataFrame, key: str, row: str, cells: str) -> DataFrame:
    """key, field, value: column 0 names the rest; a repeated name keeps its last row; single cells are notes."""
    full = F.filter(F.col(cells), lambda c: strip(c) != "")
    r = rows.withColumn("__full", full).filter(F.size("__full") > 0)
    single = F.size("__full") == 1
    note = F.concat(F.lit("_note_"), F.row_number().over(Window.partitionBy(key, single).orderBy(row)).cast("string"))
    name = F.when(single, note).otherwise(F.get("__full", F.lit(0)))
    value = F.when(single, F.get("__full", F.lit(0))).otherwise(F.array_join(F.slice("__full", F.lit(2), F.size("__full")), " | "))
    return r.select(key, name.alias("field"), value.alias("value"), F.col(row).alias("__r")).groupBy(key, "field").agg(F.max_by("value", "__r").alias("value"))


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def compile_filters(df: DataFrame, filters: str | list[dict]) -> Column:
    """A condition from a list of {column, operator, value}: contains, equals, gte, lte, joined by and.

    Unknown columns and operators, bounds of text columns and bounds that aren't numbers raise ValueError.
    """
    conditions = json.loads(filters) if isinstance(filters, str) else filters
    if not isinstance(conditions, list):
        raise ValueError("filters must be a list")
    out = F.lit(True)
    kinds = {f.name: f.dataType for f in df.schema if f.name not in HIDDEN}
    for c in conditions:
        if not isinstance(c, dict) or not {"column", "operator", "value"} <= set(c):
            raise ValueError(f"not a condition: {c!r}")
        name, op, value = c["column"], c["operator"], c["value"]
        if name not in kinds:
            raise ValueError(f"no column {name!r}")
        col = F.col(f"`{name}`")
        if op == "contains":
            out = out & col.cast("string").ilike(f"%{escape_like(str(value))}%")
        elif op == "equals":
            out = out & (col == F.lit(value))
        elif op in ("gte", "lte"):
            if not isinstance(kinds[name], NumericType) or isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"{op} needs a number and a numeric column")
            out = out & ((col >= value) if op == "gte" else (col <= value))
        else:
            raise ValueError(f"no operator {op!r}")
    return out


def filter_text_rows(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """The same conditions on rows of text: bounds compare as numbers, what isn't one never matches."""
    for c in conditions:
        col, v = F.col(f"`{c['column']}`"), c["value"]
        if c["operator"] == "contains":
            df = df.filter(F.contains(F.lower(col), F.lit(str(v).lower())))
        elif c["operator"] == "equals":
            df = df.filter(col == F.lit(str(v)))
        else:
            n = F.regexp_replace(col, ",", "").try_cast("double")
            df = df.filter(n >= v if c["operator"] == "gte" else n <= v)
    return df


def page(df: DataFrame, order: list[str], limit: int, offset: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order, each with has_more: whether rows follow the page."""
    got = df.orderBy(*order).offset(offset).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(*order))
    return got.withColumn("__n", n).withColumn("has_more", F.max("__n").over(Window.partitionBy()) > limit).filter(F.col("__n") <= limit).drop("__n")


def search_catalog(catalog: DataFrame, query: str, columns: list[str], limit: int, order: list[str]) -> DataFrame:
    """Catalog rows of which a column has the query, ``%`` and ``_`` being wildcards."""
    hit = reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{query}%") for c in columns])
    return catalog.filter(hit).orderBy(*order).limit(limit)


def nearest_heading(blocks: DataFrame, part: list[str], order: str, is_table: Column, heading: Column) -> DataFrame:
    """Tables with the heading before them in their part, or else the first one after."""
    w = Window.partitionBy(*part).orderBy(order)
    h = blocks.withColumn("__h", heading).withColumn("__t", is_table)
    before = F.last("__h", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("__h", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return h.withColumn("heading", F.coalesce(before, after)).filter("__t").drop("__h", "__t")


def table_identity(heading: Column) -> tuple[Column, Column]:
    """Code and title of a heading such as 'X010102 Title'."""
    code = F.regexp_extract(strip(heading), r"^([A-Za-z]\d{6})\s+", 1)
    return code, F.when(code != "", F.regexp_replace(strip(heading), r"^[A-Za-z]\d{6}\s+", "")).otherwise(strip(heading))


def empty_ratio(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: squash(c) == "")) / F.greatest(F.size(cells), F.lit(1))
