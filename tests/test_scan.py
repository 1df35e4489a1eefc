"""Scans by a non-commutative composition, against a plain loop."""

import random

from pyspark.sql import functions as F

from pairlab.operators import scan as S
from pairlab.operators.training_log import early_stop_step, running_best


def test_monoid_scan_concatenates_in_order(spark):
    rng = random.Random(2)
    rows = [(g, s, rng.choice("abcdef")) for g in ("x", None) for s in rng.sample(range(200), 90)]
    df = spark.createDataFrame(rows, "g string, s int, c string").repartition(5)
    join = lambda a: F.aggregate(a, F.lit(""), lambda x, e: F.concat(x, e["c"]))
    out = S.monoid_scan(df, ["g"], [F.col("s")], S.step_bucket(F.col("s"), 7), [F.col("s"), F.col("c")], join, F.lit(""), lambda a, b: F.concat(a, b), fan=3)
    n = 0
    for r in out.collect():
        series = sorted((s, c) for g, s, c in rows if g == r.g)
        first = r.entries[0].s
        assert r.before == "".join(c for s, c in series if s < first)
        assert [(e.s, e.c) for e in r.entries] == [x for x in series if x[0] // 7 == first // 7]
        n += len(r.entries)
    assert n == len(rows)


def stopped(series, patience, threshold, sign):
    best, bad, stop, at_stop = None, 0, None, None
    for step, v in series:
        if stop is not None:
            break
        if best is None or best - sign * v > threshold:
            best, bad = sign * v, 0
        else:
            bad += 1
            if bad == patience:
                stop = step
    return stop, sign * best, len(series)


def test_early_stop_against_a_loop(spark):
    rng = random.Random(9)
    rows = []
    for run in [*range(60), None]:
        level, n = 5.0, rng.randint(1, 60)
        for step in sorted(rng.sample(range(1, 90), n)):
            level -= rng.choice([0.5, 0.02, 0.005, 0.0, -0.01]) * rng.random()
            rows.append((run, "loss", step, round(level, 3)))
    df = spark.createDataFrame(rows, "run int, metric string, step bigint, value double").repartition(7)
    for mode, patience, width in (("min", 3, 4), ("min", 1, 1000), ("max", 2, 5), ("min", 6, 2)):
        got = {r.run: (r.stop_step, r.best_value, r.n_evals) for r in early_stop_step(df, patience=patience, threshold=0.01, mode=mode, steps_per_bucket=width).collect()}
        sign = 1.0 if mode == "min" else -1.0
        assert got == {run: stopped(sorted((s, v) for r, _, s, v in rows if r == run), patience, 0.01, sign) for run in {r[0] for r in rows}}


def test_a_hot_run_is_spread_and_nothing_runs_early(spark):
    log = spark.range(1, 300_001).selectExpr("cast(1 as bigint) run", "'loss' metric", "id step", "1.0 / id value")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan only", "no job while the plan is built")
    out = early_stop_step(log, patience=3, threshold=1e-9, steps_per_bucket=1 << 12)
    best = running_best(log, steps_per_bucket=1 << 12)
    assert not tracker.getJobIdsForGroup("plan only")
    spark.sparkContext.setJobGroup("run", "run")
    r = out.collect()[0]
    stop, best_value, _ = stopped([(i, 1.0 / i) for i in range(1, 300_001)], 3, 1e-9, 1.0)
    assert (r.stop_step, r.n_evals) == (stop, 300_000) and abs(r.best_value - best_value) < 1e-12
    assert S.bucketed(log, ["run", "metric"], [F.col("step")], S.step_bucket(F.col("step"), 1 << 12), [F.col("value")]).count() == 74
    assert best.filter("improved").count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan.lower()


def test_empty_log(spark):
    log = spark.createDataFrame([], "run int, metric string, step bigint, value double")
    assert early_stop_step(log).count() == 0
