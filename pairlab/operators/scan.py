"""Ordered scans of few, very large groups by any associative composition.

Rows of a group are cut into buckets of bounded width along a dense order (a
step number); a bucket is one row holding its entries in order.  A scan then is

1. one value per bucket (a fold of its entries),
2. what comes before each bucket: ``exclusive_scan`` composes the values of the
   earlier buckets, in two levels, so that no task sees all buckets of a group,
3. the replay of each bucket from that value.

The composition must be associative; it need not be commutative (composing state
tables, concatenating and cutting).  No step reads the data while the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.operators.ranking import group_key

STEPS_PER_BUCKET = 1 << 16
BUCKETS_PER_CLASS = 1 << 10


def step_bucket(step: Column, width: int = STEPS_PER_BUCKET) -> Column:
    """Bucket of a dense number; null steps come first."""
    return F.coalesce(F.floor(step / F.lit(width)).cast("bigint"), F.lit(-(1 << 62)))


def bucketed(df: DataFrame, by: Sequence[str], order: Sequence[Column], bucket: Column, values: Sequence[Column],
             entries: str = "entries") -> DataFrame:
    """One row per (by, bucket): ``_bucket`` and ``entries``, an array of the values in order.

    The rows stay partitioned by ``_bucket`` and the ``_key_i`` columns, which tell null groups
    from others, so the scans join on them without another shuffle.
    """
    keys = [f"_key_{i}" for i in range(len(by))]
    keyed = df.select(*by, *(group_key(c).alias(k) for c, k in zip(by, keys)), bucket.alias("_bucket"),
                      F.struct(F.struct(*order).alias("o"), F.struct(*values).alias("v")).alias("_e"))
    held = keyed.groupBy(*keys, "_bucket").agg(*(F.first(c).alias(c) for c in by), F.sort_array(F.collect_list("_e")).alias("_e"))
    return held.select(*keys, *by, "_bucket", F.transform("_e", lambda e: e["v"]).alias(entries))


def exclusive_scan(buckets: DataFrame, by: Sequence[str], value: str, identity: Column,
                   compose: Callable[[Column, Column], Column], name: str, fan: int = BUCKETS_PER_CLASS) -> DataFrame:
    """(by, ``_bucket``, ``name``): ``identity`` composed with the values of all earlier buckets, in order.

    ``buckets`` holds one row per (by, ``_bucket``); no column of ``by`` is null.  ``fan`` neighbouring buckets are a
    class: classes are composed along the group, then buckets along their class.
    """
    by = list(by)

    def before(rows: DataFrame, keys: list[str], order: str, first: Callable[[Column], Column] | None = None) -> DataFrame:
        """Exclusive prefixes along ``order`` in each group of ``keys``, starting from ``identity``."""
        held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_all"))
        start = F.struct(identity.alias("at"), F.array().cast(f"array<struct<k:bigint,p:{rows.schema[value].dataType.simpleString()}>>").alias("out"))
        walked = F.aggregate("_all", start, lambda acc, r: F.struct(
            compose(acc["at"], r[value]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(r[order].alias("k"), acc["at"].alias("p")))).alias("out")), lambda acc: acc["out"])
        return held.select(*keys, F.explode(walked).alias("_x")).select(*keys, F.col("_x.k").alias(order), F.col("_x.p").alias(name))

    rows = buckets.select(*by, "_bucket", value, F.floor(F.col("_bucket") / fan).alias("_class"))
    inside = before(rows, [*by, "_class"], "_bucket")
    whole = (rows.groupBy(*by, "_class").agg(F.sort_array(F.collect_list(F.struct("_bucket", value))).alias("_all"))
             .select(*by, "_class", F.aggregate("_all", identity, lambda acc, r: compose(acc, r[value])).alias(value)))
    classes = before(whole, by, "_class").withColumnRenamed(name, "_class_before")
    joined = inside.join(classes, [*by, "_class"])
    return joined.select(*by, "_bucket", compose(F.col("_class_before"), F.col(name)).alias(name))


def monoid_scan(df: DataFrame, by: Sequence[str], order: Sequence[Column], bucket: Column, values: Sequence[Column],
                summary: Callable[[Column], Column], identity: Column, compose: Callable[[Column, Column], Column],
                name: str = "before", entries: str = "entries", fan: int = BUCKETS_PER_CLASS) -> DataFrame:
    """``bucketed`` rows with ``name``: the composition of all earlier buckets' ``summary(entries)``."""
    held = bucketed(df, by, order, bucket, values, entries)
    return scan_buckets(held, by, summary, identity, compose, name, entries, fan)


def scan_buckets(held: DataFrame, by: Sequence[str], summary: Callable[[Column], Column], identity: Column,
                 compose: Callable[[Column, Column], Column], name: str, entries: str = "entries", fan: int = BUCKETS_PER_CLASS) -> DataFrame:
    """The same for rows that are bucketed already; columns beside stay."""
    keys = [f"_key_{i}" for i in range(len(by))]
    totals = held.select(*keys, "_bucket", summary(F.col(entries)).alias("_total"))
    before = exclusive_scan(totals, keys, "_total", identity, compose, name, fan)
    return held.join(before, [*keys, "_bucket"])
