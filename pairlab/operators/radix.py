"""Range buckets of string keys from measured prefix counts.

A trie of key prefixes is split until each leaf holds a bounded number of rows:
one aggregation a round counts the rows of the open prefixes with their least and
greatest key; a prefix above the bound is cut anew one character after those two
part, so a long common start costs one round.  Only prefixes above the bound reach
the driver, at most ``buckets`` of them a round.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def radix_prefixes(rows: DataFrame, key: str, buckets: int = BUCKETS, name: str = "_prefix") -> DataFrame:
    """``rows`` with ``name``: the leaf of the key's trie, non-decreasing along the keys.

    No leaf holds more than a ``buckets``-th of the rows (one at least), but for
    rows with equal keys.  ``rows`` is read once a round: give a table.
    """
    spark = rows.sparkSession
    k = F.col(key)
    summary = [F.count(F.lit(1)).alias("n"), F.min(k).alias("low"), F.max(k).alias("high")]
    whole = rows.agg(*summary).first()
    bound = max(1, -(-whole["n"] // buckets))

    def cut(low: str, high: str) -> int:
        return len(commonprefix([low, high])) + 1

    if whole["n"] <= bound or whole["low"] == whole["high"]:
        return rows.withColumn(name, F.lit(""))
    rows = rows.withColumn(name, F.coalesce(F.substring(k, 1, cut(whole["low"], whole["high"])), F.lit(""))).withColumn("_open", F.lit(True))
    while True:
        heavy = (rows.filter("_open").groupBy(name).agg(*summary).filter((F.col("n") > bound) & (F.col("low") < F.col("high")))).collect()
        if not heavy:
            return rows.drop("_open")
        # at most `buckets` rows: each holds more than a bucket's share
        cuts = spark.createDataFrame([(r[name], cut(r["low"], r["high"])) for r in heavy], "_at string, _cut int")
        rows = (rows.join(F.broadcast(cuts), rows[name] == F.col("_at"), "left")
                .withColumn("_open", F.col("_cut").isNotNull())
                .withColumn(name, F.when(F.col("_open"), F.substr(k, F.lit(1), F.col("_cut"))).otherwise(F.col(name)))
                .drop("_at", "_cut"))


def descending(count: str, token: str):
    """A key whose order is descending count, then token."""
    return F.concat(F.lpad(F.hex(F.lit((1 << 63) - 1) - F.col(count)), 16, "0"), F.col(token))
