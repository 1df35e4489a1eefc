"""Co-partitioned tables: joins on the record key without a shuffle.

Articles, summaries and finished keys are saved as tables bucketed and sorted by
(article_id, language).  Tables with the same number of buckets join, are
audited and resumed bucket by bucket: the plan has no exchange, however large they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("article_id", "language")


def save_copartitioned(df: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str] = KEYS, mode: str = "overwrite") -> None:
    """``df`` as the table ``table`` at ``path``; one shuffle by the keys, then a file for each bucket."""
    keys = list(keys)
    # the same hash that deals buckets: each task writes whole buckets
    (df.repartition(buckets, *keys).write.mode(mode).option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))


def open_copartitioned(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows none of whose keys is null."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def any_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = F.lit(False)
    for k in keys:
        found = found | F.col(k).isNull()
    return df.filter(found)
