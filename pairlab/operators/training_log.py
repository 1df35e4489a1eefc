"""Metric-log operators: running best, best checkpoint, early stopping,
generation throughput, example counts.

A metric log is a long table ``(run, metric, step, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.operators.ranking import prefix_scan
from pairlab.operators.scan import STEPS_PER_BUCKET, bucketed, scan_buckets, step_bucket


def running_best(log: DataFrame, by: Sequence[str] = ("run", "metric"), step: str = "step",
                 value: str = "value", start: float = 0.0, two_level: bool = True,
                 steps_per_bucket: int = STEPS_PER_BUCKET) -> DataFrame:
    """Best-so-far before each step (starting at ``start``); ``improved`` when
    the value is strictly greater; ``best`` is the best including the step.

    ``two_level=True`` computes the running max per step bucket first, so a
    very long run is scanned by many tasks (``pairlab.operators.ranking``).
    Steps are dense numbers, so buckets are ranges of equal width.
    """
    by = list(by)
    if two_level:
        s = prefix_scan(log, by, [F.col(step)], step_bucket(F.col(step), steps_per_bucket), value, "max", name="_prev")
    else:
        w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        s = log.withColumn("_prev", F.max(value).over(w))
    prev = F.coalesce(F.col("_prev"), F.lit(start))
    return (s.withColumn("previous_best", prev)
            .withColumn("improved", F.col(value) > prev)
            .withColumn("best", F.greatest(prev, F.col(value)))
            .drop("_prev"))


def best_checkpoint(log: DataFrame, by: Sequence[str] = ("run", "metric"), step: str = "step",
                    value: str = "value", mode: str = "min") -> DataFrame:
    """Step with the min (or max) value per run; ties go to the earlier step.

    ``min_by``/``max_by`` over a struct are partial aggregates.
    """
    if mode == "min":
        pick = F.min_by(F.struct(F.col(step), F.col(value)), F.struct(F.col(value), F.col(step)))
    else:
        pick = F.max_by(F.struct(F.col(step), F.col(value)), F.struct(F.col(value), -F.col(step)))
    return log.groupBy(*by).agg(pick.alias("_b")).select(
        *by, F.col(f"_b.{step}").alias("best_step"), F.col(f"_b.{value}").alias("best_value"))


def early_stop_step(log: DataFrame, by: Sequence[str] = ("run", "metric"), step: str = "step",
                    value: str = "value", patience: int = 3, threshold: float = 0.01,
                    mode: str = "min", steps_per_bucket: int = STEPS_PER_BUCKET) -> DataFrame:
    """First step at which ``patience`` consecutive evaluations failed to
    improve the best by more than ``threshold`` (null if training never
    stops), the best value at that point, and the number of evaluations.

    The rule is sequential (the best moves only on an improvement), but its
    state is small: how many evaluations ago the last improvement happened
    (1..patience), "not started" or "stopped".  An evaluation is a table of such states,
    worked out from the ``patience`` values before it, and tables compose associatively.
    Two scans over buckets of steps (``pairlab.operators.scan``) do it:

    1. the last ``patience`` values before each bucket (the tail carried over);
    2. the state each bucket is entered in: its table is the fold of its
       evaluations from every state at once;

    then each bucket is replayed once from its state.  A run holding a third of
    the log is spread over tasks, the log is read and shuffled once, and nothing runs while
    the plan is built.
    """
    by = list(by)
    p = patience
    stop = p + 1
    sign = 1.0 if mode == "min" else -1.0
    rows = log.select(*by, F.col(step).alias("_s"), (F.col(value) * sign).cast("double").alias("_v"))
    held = bucketed(rows, by, [F.col("_s"), F.col("_v")], step_bucket(F.col("_s"), steps_per_bucket), [F.col("_s").alias("s"), F.col("_v").alias("v")])
    held = held.withColumn("_values", F.transform("entries", lambda e: e["v"]))

    def tail(values: Column) -> Column:
        n = F.size(values)
        return F.slice(values, F.greatest(n - p + 1, F.lit(1)), F.lit(p))

    held = scan_buckets(held, by, lambda _: tail(F.col("_values")), F.array().cast("array<double>"), lambda a, b: tail(F.concat(a, b)), "_tail")
    # value k evaluations before the i-th of the bucket
    held = held.withColumn("_all", F.concat("_tail", "_values"))
    at = F.size("_tail")

    def back(i: Column, k: Column) -> Column:
        return F.when(at + i >= k, F.get(F.col("_all"), at + i - k))

    def next_state(state: Column, i: Column) -> Column:
        running = (state >= 1) & (state <= p)
        improved = (state == 0) | (running & ((back(i, state) - F.get(F.col("_values"), i)) > threshold))
        return F.when(state == stop, F.lit(stop)).when(improved, F.lit(1)).when(state < p, state + 1).otherwise(F.lit(stop))

    every = F.array(*(F.lit(i) for i in range(p + 2)))
    places = F.sequence(F.lit(0), F.size("_values") - 1)
    held = scan_buckets(held, by, lambda _: F.aggregate(places, every, lambda states, i: F.transform(states, lambda s: next_state(s, i))),
                        every, lambda f, g: F.transform(f, lambda x: F.get(g, x)), "_entered")

    def replay(acc: Column, i: Column) -> Column:
        state, v = acc["state"], F.get(F.col("_values"), i)
        then = next_state(state, i)
        best = F.when(state == stop, acc["best"]).when(then == 1, v).otherwise(F.coalesce(acc["best"], back(i, state)))
        here = F.when((state != stop) & (then == stop), F.get(F.col("entries"), i)["s"].cast("bigint"))
        return F.struct(then.alias("state"), best.alias("best"), F.coalesce(acc["stop"], here).alias("stop"))

    start = F.struct(F.get(F.col("_entered"), F.lit(0)).alias("state"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("bigint").alias("stop"))
    per = held.select(*by, "_bucket", F.aggregate(places, start, replay).alias("_o"), F.size("_values").alias("_n"))
    return (per.groupBy(*by)
            .agg(F.min("_o.stop").alias("stop_step"),
                 F.min_by("_o.best", F.when(F.col("_o.stop").isNotNull(), F.col("_bucket"))).alias("_best_stop"),
                 F.max_by("_o.best", "_bucket").alias("_best_end"),
                 F.sum("_n").cast("bigint").alias("n_evals"))
            .select(*by, "stop_step",
                    (F.when(F.col("stop_step").isNotNull(), F.col("_best_stop"))
                     .otherwise(F.col("_best_end")) * sign).alias("best_value"),
                    "n_evals"))


def generation_throughput(log: DataFrame, by: Sequence[str] = ("language",), rows: str = "n_rows",
                          seconds: str = "seconds") -> DataFrame:
    """Rows and rows/second per group over per-batch log rows."""
    return (log.groupBy(*by).agg(F.count(F.lit(1)).alias("batches"), F.sum(rows).alias("total_rows"),
                                 F.sum(seconds).alias("total_seconds"),
                                 F.avg(F.try_divide(F.col(rows), F.col(seconds))).alias("mean_batch_rows_per_sec"))
            .withColumn("rows_per_sec", F.try_divide(F.col("total_rows"), F.col("total_seconds"))))


def example_count(log: DataFrame, batch_size: int, accumulation: int = 1, step: str = "step") -> DataFrame:
    """Examples seen at a step = step x batch x gradient accumulation."""
    return log.withColumn("examples_seen", (F.col(step) * F.lit(batch_size * accumulation)).cast("bigint"))
