"""Mixing sources to target weights (operator 9), DataFrame functions only.

Capped water-filling: sources share the corpus size by weight; a source whose
share passes ``max_epochs`` times its own size is clamped there and the excess
goes to the others in proportion, until none is above.  Sorted by cap / weight
the clamped sources come first, so one pass of prefix sums over the table of
sources (one row per source) finds the fixed point; the comparison is exact
(decimals).  Inside a source every document is taken a whole number of times,
and a seeded order decides which ones are taken once more: documents fall into
4096 buckets by the head of a seeded digest of id and text, bucket sums are pre-aggregated and
prefix-summed, so only the one bucket in which the remainder runs out is
ordered, by digests and sizes alone.  What comes out of it is one digest per source, below
which documents are taken once more: texts are compared with it where they are, without
a shuffle.  A source holding a third of all rows is thus spread over
all tasks.  The words taken miss the target by half a document at most.

Defined results: a null text has size 0; a null source is a source (the last);
a source without words has target 0; rows with equal or null ids are documents
of their own, told apart by their texts; of rows that are equal in both as many are taken once
more as the target asks for; an empty table gives no rows;
other columns pass through, those called like an output are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.packing import packed, unpacked
from pairlab.llm.registry import BLANKS, query, read
from pairlab.session import scratch_path

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_DIGITS = 3  # 16 ** 3 buckets in each source

OUT = ["size", "source_size", "target", "taken", "repeats"]


def word_count(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS, -1)
    return F.size(F.array_remove(parts, "")).cast("bigint")


def weigh_by_order(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source)`` -> ``(source, weight)``: weights repeat over the sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.select("source", F.element_at(
        F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint").alias("weight"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, weight)`` -> the same with ``target`` (double)."""
    d = lambda c: c.cast("decimal(38,0)")
    cap = F.col("source_size") * max_epochs
    every = Window.partitionBy()
    by_level = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    out = (sources.withColumn("cap", cap)
           .withColumn("total", F.sum("source_size").over(every))
           .withColumn("weights", F.sum("weight").over(every))
           .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
           .withColumn("left_size", F.col("total") - F.col("cap_before"))
           .withColumn("left_weight", F.col("weights") - F.col("weight_before")))
    clamped = d(F.col("cap")) * d(F.col("left_weight")) < d(F.col("weight")) * d(F.col("left_size"))
    out = out.withColumn("clamped", clamped)
    # the level is the remainder over the remaining weight, after the last clamped source
    out = out.withColumn("fill_size", F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(every), F.lit(0)))
    out = out.withColumn("fill_weight", F.col("weights") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("weight"))).over(every), F.lit(0)))
    share = (F.col("weight") * F.col("fill_size")).cast("double") / F.col("fill_weight").cast("double")
    return out.select("source", "source_size", "weight",
                      F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id",
        source: str = "source", max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken, repeats``.

    ``weights`` is a ``(source, weight)`` table of positive whole weights;
    without it the default weights repeat over the sources by code point.
    """
    body = F.md5(F.coalesce(F.col(text), F.lit("")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), body))
    rows = packed(docs, source=F.col(source), size=word_count(F.col(text)), h=digest)
    light = rows.select("source", "size", "h", F.substring("h", 1, BUCKET_DIGITS).alias("bucket"))
    cuts = _cuts(light, weights, max_epochs, docs.sparkSession)
    c = cuts.select(F.col("source").alias("c_source"), "source_size", "target", "whole", "cut", "at_cut")
    joined = rows.join(c, F.col("source").eqNullSafe(F.col("c_source")))

    def out(df: DataFrame, more) -> DataFrame:
        df = df.withColumn("repeats", F.col("whole") + more.cast("bigint"))
        df = df.select("row", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")
        return unpacked(df, docs.columns, OUT)

    below = F.col("h") < F.col("cut")
    if cuts.filter("at_cut > 0").isEmpty():
        return out(joined, below)
    # equal rows of which some are taken once more
    tied = (F.col("h") == F.col("cut")) & (F.col("at_cut") > 0)
    place = F.row_number().over(Window.partitionBy("source", "h").orderBy("h"))
    return out(joined.filter(~tied), below).unionByName(out(joined.filter(tied).withColumn("place", place), F.col("place") <= F.col("at_cut")))


def _cuts(light: DataFrame, weights: DataFrame | None, max_epochs: int, spark) -> DataFrame:
    """``(source, source_size, target, whole, cut, at_cut)``, one row per source, as a table.

    Documents below the digest ``cut`` are taken ``whole + 1`` times, ``at_cut`` of those at it, the others ``whole`` times.
    """
    buckets = light.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    shares = weigh_by_order(sizes.select("source")) if weights is None else weights.select("source", "weight")
    shares = shares.withColumnRenamed("source", "w_source")
    plan = water_fill(sizes.join(shares, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source"), max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    plan = plan.withColumn("extra", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    p = plan.select(F.col("source").alias("p_source"), "source_size", "target", "whole", "extra")
    b = b.join(p, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    folder = scratch_path(spark, f"mix-{uuid.uuid4().hex}")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    inside = (F.col("before") < F.col("extra")) & (F.col("before") + F.col("bucket_size") > F.col("extra"))
    b = written(b.groupBy("source").agg(*(F.first(c).alias(c) for c in ("source_size", "target", "whole", "extra")),
                                        F.min(F.when(F.col("before") >= F.col("extra"), F.col("bucket"))).alias("next"),
                                        F.min(F.when(inside, F.struct("bucket", "before"))).alias("edge")), "sources")
    edge = b.filter("edge is not null").select(F.col("source").alias("e_source"), F.col("edge.bucket").alias("e_bucket"), F.col("edge.before").alias("before"), "extra")
    held = (light.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("e_bucket")))
            .groupBy("source", "h", "size", "before", "extra").agg(F.count(F.lit(1)).alias("copies")))
    order = Window.partitionBy("source").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0))
    first = (2 * F.col("reach") + F.col("size")).cast("double") <= 2 * F.col("extra")  # the middle of the first copy lies below
    fits = F.floor((F.col("extra") - F.col("reach") - F.col("size") / 2) / F.nullif(F.col("size"), F.lit(0))) + 1
    taken = F.when(~first, 0).otherwise(F.greatest(F.lit(1), F.least(F.col("copies"), F.coalesce(fits, F.col("copies")))))
    ends = held.withColumn("reach", reach).withColumn("taken", taken).filter("taken < copies")
    ends = ends.groupBy(F.col("source").alias("e_source")).agg(F.min(F.struct("h", "taken")).alias("end"))
    cuts = b.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left")
    return written(cuts.select("source", "source_size", "target", "whole", F.coalesce("end.h", "next", F.lit("g")).alias("cut"),
                               F.coalesce("end.taken", F.lit(0)).cast("bigint").alias("at_cut")), "cuts")


_SQL = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
                  md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as h from documents),
s as (select source, sum(size)::hugeint as n, row_number() over (order by source collate "C" nulls last) as k from d group by source),
w as (select source, n, case (k - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
p as (select *, 3 * n as cap, sum(n) over () as total, sum(weight) over () as weights,
             coalesce(sum(3 * n) over o, 0) as cap_before, coalesce(sum(weight) over o, 0) as weight_before
      from w window o as (order by 3 * n / weight, source nulls last rows between unbounded preceding and 1 preceding)),
c as (select *, cap * (weights - weight_before) < weight * (total - cap_before) as clamped from p),
f as (select *, total - coalesce(sum(cap) filter (where clamped) over (), 0) as fill_size,
             weights - coalesce(sum(weight) filter (where clamped) over (), 0) as fill_weight from c),
t as (select source, n, case when clamped then cap::double else (weight * fill_size)::double / fill_weight::double end as target from f),
e as (select *, case when n > 0 then floor(target / n)::bigint else 0 end as whole from t),
x as (select source as x_source, n::bigint as source_size, target, whole, target - (whole * n)::double as extra from e),
r as (select d.*, source_size, target, whole, extra,
             coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as reach
      from d join x on d.source is not distinct from x.x_source)
select doc_id, size, source_size, target,
       (size * (whole + case when (2 * reach + size)::double <= 2 * extra then 1 else 0 end))::bigint as taken from r
""".replace(' collate "C"', "")


@query("op9_mixing", _SQL)
def op9_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
