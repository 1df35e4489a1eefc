"""Registry of the operator queries and the table reader they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairlab.sources.tables import SCHEMAS, table_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# words are runs of anything but the space and the five ASCII control blanks
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as a query, with its DuckDB SQL if there is one."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table with its declared schema (plain scan, no shuffle)."""
    return spark.read.schema(SCHEMAS[name]).parquet(table_path(sf_dir, name))
