"""Typed access to the input tables.

Every read uses an explicit schema (no inference), so a column-pruned
projection reaches the Parquet scan as ``ReadSchema`` and filters are pushed
as ``PushedFilters``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# tables whose rows carry long texts or vectors: per-row work on them is CPU heavy
TEXT_TABLES = {"documents", "conversations", "pages", "benchmark", "embeddings"}


SPLITS = "spark.pairlab.textSplits"


def load_table(spark: SparkSession, sf_dir: str, name: str, splits: int | None = None) -> DataFrame:
    """Read one driver table with its declared schema.

    A Parquet file written as a single row group is read by one task however
    it is split, so every per-row text step before the first shuffle would
    run in one task.  A caller who has such files asks for ``splits`` (or sets
    ``spark.pairlab.textSplits``): text tables are then dealt into that many
    partitions right after the scan.  Without it the scan is left as it is.
    """
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    df = reader.parquet(table_path(sf_dir, name))
    if splits is None and name in TEXT_TABLES:
        splits = int(spark.conf.get(SPLITS, "0"))
    return df.repartition(splits) if splits else df


class Tables:
    """Lazy accessor: ``Tables(spark, dir).documents`` is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return load_table(self.spark, self.sf_dir, name)
