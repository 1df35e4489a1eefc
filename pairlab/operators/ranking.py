"""Exact ranks and prefix aggregates over few, very large groups.

A plain ``row_number().over(Window.partitionBy(language).orderBy(...))``
sends every row of a language to one task: with four languages, four
tasks sort the whole corpus.  Here the order is cut into *range buckets*
(a monotone function of the order key), so

1. ``groupBy(group, bucket).count()``       -- map-side partial counts
2. running sum of the counts over buckets   -- tiny table (groups x buckets)
3. join the offsets back                    -- AQE broadcasts it when its
                                               measured size is small
4. ``row_number()`` inside (group, bucket)  -- many bounded partitions

rank = offset(bucket) + row_number-in-bucket is exactly the global rank.
The same recipe gives running max/min/sum (``prefix_scan``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 16 bits of a hex hash -> 65,536 buckets per group.
HASH_BUCKET_HEX = 4
NUMERIC_BUCKETS = 4096


def seeded_key(key: Column | str, seed: int | str) -> Column:
    """Reproducible pseudo-random order key: md5("{seed}:{key}") (hex)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def hex_bucket(hex_col: Column, digits: int = HASH_BUCKET_HEX) -> Column:
    """Leading hex digits of a hash as an integer: monotone in the hash."""
    return F.coalesce(F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("bigint"), F.lit(-1))


def numeric_bucket(df: DataFrame, order_col: str, buckets: int = NUMERIC_BUCKETS,
                   rows_per_bucket: int | None = None) -> Column:
    """Equal-width range bucket of a numeric order column, for dense positions
    (``balanced_bucket`` is the one for values of any distribution).

    One tiny aggregation (min, max, count) sizes the buckets; the result is a
    monotone bucket id in ``[0, buckets)``.  With ``rows_per_bucket`` the
    bucket count grows with the data (at least ``count / rows_per_bucket``).
    """
    row = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi"),
                 F.count(F.lit(1)).alias("n")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        return F.lit(0).cast("bigint")
    n = int(row["n"])
    # ~sqrt(n) buckets balance the two levels (rows per bucket vs buckets per group)
    buckets = max(buckets, math.isqrt(n) + 1)
    if rows_per_bucket:
        buckets = max(buckets, -(-n // rows_per_bucket))
    width = max((float(hi) - float(lo)) / buckets, 1e-12)
    b = F.floor((F.col(order_col).cast("double") - F.lit(float(lo))) / F.lit(width))
    # nulls come first in ascending order
    return F.coalesce(F.least(F.greatest(b, F.lit(0)), F.lit(buckets - 1)).cast("bigint"), F.lit(-1))


@dataclass(frozen=True)
class SplitBucket:
    """A bucket given by split points that the plan itself works out (``with_bucket`` adds it to rows)."""

    value: Column
    points: Column
    bits: int
    then: SplitBucket | None = None  # inside buckets of one value


def balanced_bucket(df: DataFrame, order_col: str, buckets: int = 1024, then: Sequence[str] = ()) -> SplitBucket:
    """Range bucket of a numeric order column by approximate quantiles.

    The ``buckets - 1`` split points (a bounded array) are a scalar subquery of the plan:
    nothing runs while the plan is built, and every branch of a query that uses
    the bucket shares the one result.  A heavy tail or an outlier doesn't put most
    rows into one bucket as equal widths would.  A split point's own value is a bucket of
    its own, so a value that many rows share is one; ``then`` names the next order columns, by the
    first of which (if it is a number) such buckets are split again.
    """
    qs = [i / buckets for i in range(1, buckets)]
    value = F.col(order_col).cast("double")
    found = df.agg(F.percentile_approx(F.when(~F.isnan(value), value), qs, 20 * buckets).alias("s"))
    points = found.select(F.coalesce(F.array_sort(F.array_distinct("s")), F.array().cast("array<double>"))).scalar()
    next_ = balanced_bucket(df, then[0], buckets) if then and isinstance(df.schema[then[0]].dataType, T.NumericType) else None
    return SplitBucket(value, points, (buckets - 1).bit_length(), next_)


def with_bucket(df: DataFrame, bucket: Column | SplitBucket, name: str = "_bucket") -> DataFrame:
    if isinstance(bucket, SplitBucket):
        # the points are a column of their own first: a higher-order function holds no subquery
        found = split_bucket(bucket.value, F.col("_points"), bucket.bits)
        df = df.withColumn("_points", bucket.points).withColumn(name, found).drop("_points")
        if bucket.then is None:
            return df
        df = with_bucket(df, bucket.then, "_then")
        # odd buckets hold one value, along which the next order column ascends
        return df.withColumn(name, F.struct(F.col(name).alias("a"), F.when(F.col(name) % 2 == 1, F.col("_then")).alias("b"))).drop("_then")
    return df.withColumn(name, bucket)


def _bucketed(df: DataFrame, bucket: Column | SplitBucket) -> DataFrame:
    """``_bucket`` as a struct of the bucket, so that a null bucket equals itself in joins and comes first."""
    return with_bucket(df, bucket, "_plain").withColumn("_bucket", F.struct(F.col("_plain").alias("v"))).drop("_plain")


def split_bucket(value: Column, points: Column, bits: int) -> Column:
    """Twice the number of split points below the value (binary search), one more at a split point; nulls come first."""
    both = F.struct(value.alias("x"), points.alias("points"))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(bits))))

    def search(t: Column) -> Column:
        below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= F.size(t["points"])) & (F.get(t["points"], at + step - 1) < t["x"]), at + step).otherwise(at))
        both = F.array(F.struct(below.alias("n"), t["points"].alias("points"), t["x"].alias("x")))
        return F.element_at(F.transform(both, lambda s: 2 * s["n"] + F.coalesce(F.get(s["points"], s["n"]) == s["x"], F.lit(False)).cast("int")), 1)

    found = F.element_at(F.transform(F.array(both), search), 1)
    return F.when(value.isNull(), F.lit(-1)).otherwise(found).cast("bigint")


def group_key(col: str) -> Column:
    """A group column as a string that tells null from every value: null groups
    are groups too, and a join on it needs no null-safe comparison (which would
    cost another shuffle)."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def _with_keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    names = [f"_key_{i}" for i in range(len(by))]
    return df.withColumns({n: group_key(c) for n, c in zip(names, by)}), names


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal; the keys of ``left`` stay."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(right, reduce(lambda a, b: a & b, on), how).drop(*(f"_right_{k}" for k in keys))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], bucket: Column | SplitBucket,
           name: str = "rank", limit: int | None = None, total: str | None = None,
           coarse: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``name`` = exact 1-based row_number within ``by`` in ``order``.

    ``bucket`` must be non-decreasing along ``order``.  Plan:

    * one shuffle of the rows on (group, bucket), ``row_number`` inside it;
    * bucket sizes are read off that windowed result (the exchange is reused,
      the input is computed once), running sums over the small
      (group, bucket) table give each bucket's offset;
    * the offsets join back onto rows that are already partitioned by
      (group, bucket) (AQE broadcasts the offsets when they are small).

    With ``limit`` rows beyond it are dropped before the join.  With
    ``total`` the group size is added as that column.  ``coarse`` gives a few
    classes of buckets (non-decreasing along the buckets): running sums are then
    taken over the classes and inside each, so that no task sees all buckets.
    Null groups are groups of their own, a null bucket comes first.
    """
    with_keys, by = _with_keys(df, list(by))
    keys = by + ["_bucket"]
    local = (_bucketed(with_keys, bucket)
             .withColumn("_lr", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))))
    sizes = local.groupBy(*keys).agg(F.max("_lr").alias("_bucket_n"))
    if coarse:
        sizes = sizes.withColumn("_class", F.struct(coarse(F.col("_bucket.v")).cast("bigint").alias("v")))
        classes = sizes.groupBy(*by, "_class").agg(F.sum("_bucket_n").alias("_class_n"))
        wc = Window.partitionBy(*by).orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
        classes = classes.withColumn("_class_offset", F.coalesce(F.sum("_class_n").over(wc), F.lit(0)))
        w = Window.partitionBy(*by, "_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offs = sizes.withColumn("_inside", F.coalesce(F.sum("_bucket_n").over(w), F.lit(0)))
        offs = offs.join(classes, [*by, "_class"]).withColumn("_offset", F.col("_class_offset") + F.col("_inside"))
    else:
        w = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offs = sizes.withColumn("_offset", F.coalesce(F.sum("_bucket_n").over(w), F.lit(0)))
    keep = keys + ["_offset"]
    if total:
        offs = offs.withColumn(total, F.sum("_bucket_n").over(Window.partitionBy(*by)))
        keep.append(total)
    if limit is not None:
        offs = offs.filter(F.col("_offset") < limit)
        local = local.filter(F.col("_lr") <= limit)
    out = local.join(offs.select(*keep), keys, "inner")
    out = out.withColumn(name, (F.col("_offset") + F.col("_lr")).cast("bigint"))
    if limit is not None:
        out = out.filter(F.col(name) <= limit)
    return out.drop("_bucket", "_offset", "_lr", *by)


def prefix_scan(df: DataFrame, by: Sequence[str], order: Sequence[Column], bucket: Column | SplitBucket,
                value: str, how: str = "max", name: str | None = None,
                inclusive: bool = False) -> DataFrame:
    """Running aggregate of ``value`` over earlier rows in ``order``.

    ``how`` in max/min/sum.  ``inclusive=False`` covers strictly earlier
    rows (frame ``unboundedPreceding .. -1``).  Two-level like ``ranked``: a
    window inside each (group, bucket), bucket totals read off the windowed
    rows (exchange reused), a running total over the small bucket table, and
    a join back onto the already partitioned rows.
    """
    with_keys, by = _with_keys(df, list(by))
    keys = by + ["_bucket"]
    name = name or f"running_{how}"
    agg = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    end = 0 if inclusive else -1
    wi = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = _bucketed(with_keys, bucket).withColumn("_inner", agg(value).over(wi))
    per_bucket = local.groupBy(*keys).agg(agg(value).alias("_bv"))
    wb = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.withColumn("_carry", agg("_bv").over(wb)).select(*keys, "_carry")
    joined = local.join(carry, keys, "inner")
    inner = F.col("_inner")
    if how == "sum":
        combined = F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(inner, F.lit(0))
        combined = F.when(F.col("_carry").isNull() & inner.isNull(), F.lit(None)).otherwise(combined)
    else:
        pick = F.greatest if how == "max" else F.least
        combined = pick(F.col("_carry"), inner)  # greatest/least skip nulls
    return joined.withColumn(name, combined).drop("_bucket", "_carry", "_inner", *by)
