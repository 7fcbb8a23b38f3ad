"""JSON documents as Variant: typed path predicates, projections and changes by path.

A document is parsed once and stored as a Variant column; a path is read without parsing the text again.  A document that
isn't JSON is null, and a predicate on what a document lacks, or has in another type, is not met.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = re.compile(r"""\.([A-Za-z_][A-Za-z0-9_]*)|\[(\d+)\]|\['((?:[^'\\]|\\.)*)'\]|\["((?:[^"\\]|\\.)*)"\]""")
TESTS = {"eq", "ne", "gt", "gte", "lt", "lte", "in", "contains", "exists"}


def parsed(text: Column) -> Column:
    """The document in a text; null for what isn't JSON."""
    return F.try_parse_json(text)


def steps(path: str) -> list[str | int]:
    """The keys and indexes of a path such as ``$.a[0]['b c']``; another path raises ValueError."""
    if not path.startswith("$"):
        raise ValueError(f"not a path: {path!r}")
    at, out = 1, []
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"not a path: {path!r}")
        out.append(int(m[2]) if m[2] is not None else next(g for g in (m[1], m[3], m[4]) if g is not None))
        at = m.end()
    return out


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"


def value_at(document: Column, path: str, kind: str = "string") -> Column:
    """The value at a path as a SQL type; null where there is none, or it can't be cast."""
    steps(path)
    return F.try_variant_get(document, path, kind)


def where(document: Column, path: str, test: str, value=None) -> Column:
    """A typed predicate; the type is that of ``value``.  Numbers are compared as numbers and texts as texts only."""
    if test not in TESTS:
        raise ValueError(f"unknown test {test!r}")
    there = F.try_variant_get(document, path, "variant")
    if test == "exists":
        steps(path)
        return there.isNotNull()
    some = list(value) if test == "in" else [value]
    if not some:
        return F.lit(False)
    kinds = {_kind(v) for v in some}
    kind = "double" if kinds == {"bigint", "double"} else kinds.pop() if len(kinds) == 1 else None
    if kind is None:
        raise ValueError("values of one type are needed")
    steps(path)
    held = F.schema_of_variant(there)
    numbers = held.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    fits = {"string": held == "STRING", "boolean": held == "BOOLEAN"}.get(kind, numbers)
    got = F.try_variant_get(document, path, "double" if kind == "bigint" and test in ("gt", "gte", "lt", "lte") else kind)
    if kind == "bigint" and test in ("eq", "ne", "in"):
        got = F.try_variant_get(document, path, "double")
    passed = {
        "eq": lambda: got == some[0], "ne": lambda: got != some[0], "gt": lambda: got > some[0], "gte": lambda: got >= some[0], "lt": lambda: got < some[0], "lte": lambda: got <= some[0],
        "in": lambda: got.isin(some), "contains": lambda: F.contains(got.cast("string"), F.lit(str(some[0]))),
    }[test]()
    return F.coalesce(fits & passed, F.lit(False))


def put(document: Column, path: str, value: Column) -> Column:
    """The document with ``value`` at a path of keys, whose objects are made where they are missing.

    What isn't an object on the way gives way to one; a null document is an empty one.
    """
    keys = steps(path)
    if not keys or not all(isinstance(k, str) for k in keys):
        raise ValueError("a path of keys is needed")
    return _put(document, keys, value)


def _put(document: Column, keys: list, value: Column) -> Column:
    empty = F.create_map().cast("map<string,variant>")
    is_object = F.startswith(F.coalesce(F.schema_of_variant(document), F.lit("")), F.lit("OBJECT"))
    fields = F.when(is_object, F.try_variant_get(document, "$", "map<string,variant>")).otherwise(empty)
    fields = F.coalesce(fields, empty)
    key = F.lit(keys[0])
    inner = F.to_variant_object(F.create_map(F.lit("v"), value)) if len(keys) == 1 else None
    new = F.variant_get(inner, "$.v", "variant") if inner is not None else _put(F.try_element_at(fields, key), keys[1:], value)
    return F.to_variant_object(F.map_concat(F.map_filter(fields, lambda k, v: k != key), F.create_map(key, new)))


def upsert_at(documents: DataFrame, changes: DataFrame, key: str, column: str, path: str) -> DataFrame:
    """``documents`` (key, Variant column) with ``changes`` (key, value) put at a path; new keys are new documents.

    A key stands once in either; a null value is put as a null.
    """
    told = changes.select(F.col(key), F.col("value"), F.lit(True).alias("__told"))
    both = documents.join(told, key, "full")
    now = F.when(F.col("__told"), put(F.col(column), path, F.col("value"))).otherwise(F.col(column))
    return both.withColumn(column, now).drop("value", "__told")
