"""Access to the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docgrid.operators.staging import folder, spread
from docgrid.session import Warehouse

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
READ_PARTITIONS = "spark.docgrid.readPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; where the session sets ``spark.docgrid.readPartitions``, tables of texts are dealt over so many
    partitions, for a caller whose table is one row group, of which a scan can make one task only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    asked = spark.conf.get(READ_PARTITIONS, "")
    return df.repartition(int(asked)) if asked and name in ("documents", "pages") else df


def scratch_house(spark: SparkSession) -> Warehouse:
    """A warehouse of its own in the shared folder, for queries over stored indexes."""
    return Warehouse(spark, f"{folder(spark)}/docgrid-house-{uuid.uuid4().hex}")


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows that a query which both engines understand makes from the tables; it names them in braces.

    Tables are dealt by their key before: a narrow one is a single row group, of which a scan makes one task, while what is
    made of its rows (pages, tables, clauses) takes time.
    """
    return spark.sql(sql, **{t: spread(table(spark, sf_dir, t)) for t in TABLES if f"{{{t}}}" in sql})


def as_duck(sql: str) -> str:
    """The same query for DuckDB."""
    return sql.format(**{t: t for t in TABLES})
