"""LCS against a dynamic-programming oracle; two-level ranks against row_number."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlab.operators import metrics as M
from pairlab.operators.ranking import hex_bucket, numeric_bucket, prefix_scan, ranked, seeded_key


def naive_lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    return dp[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_lcs_length(a, b):
    assert M.lcs_length(a, b) == naive_lcs(a, b)
    assert len(M.lcs_positions(a, b)) == naive_lcs(a, b)


def test_lcs_long_text():
    rnd = random.Random(1)
    a = [rnd.choice("abcdefgh") for _ in range(3000)]
    b = [rnd.choice("abcdefgh") for _ in range(2000)]
    assert M.lcs_length(a, b) == naive_lcs(a, b)


def test_rouge_l_udf(spark):
    df = spark.createDataFrame([("a", "the cat sat on the mat", "the cat on mat"), ("b", "x y", ""),
                                ("c", "a b c", "a b c")], "k string, reference string, generated string")
    r = {x["k"]: x for x in M.rouge_l(df, ["k"]).collect()}
    assert r["a"]["rougeL_p"] == 1.0 and abs(r["a"]["rougeL_r"] - 4 / 6) < 1e-12
    assert r["b"]["rougeL_f"] == 0.0 and r["c"]["rougeL_f"] == 1.0
    s = {x["k"]: x for x in M.rouge_lsum(df, ["k"]).collect()}
    assert s["c"]["rougeLsum_f"] == 1.0 and s["b"]["rougeLsum_f"] == 0.0


def test_ranked_matches_row_number(spark):
    rnd = random.Random(7)
    # one hot group with a third of the rows
    rows = [(("hot" if i % 3 == 0 else f"g{rnd.randint(0, 20)}"), rnd.randint(0, 500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x long, id long").repartition(5)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("x", "id")).cast("long"))
    got = ranked(df, ["g"], [F.col("x"), F.col("id")], numeric_bucket(df, "x", 64))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.select("g", "x", "id", "rank").collect()))
    lim = ranked(df, ["g"], [F.col("x"), F.col("id")], numeric_bucket(df, "x", 64), limit=10)
    assert lim.filter(F.col("g") == "hot").count() == 10


def test_ranked_hash_order(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("g"))
    h = df.withColumn("_h", seeded_key("k", 42))
    got = ranked(h, ["g"], [F.col("_h"), F.col("k")], hex_bucket(F.col("_h")))
    want = h.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("_h", "k")).cast("long"))
    assert sorted(map(tuple, got.select("k", "rank").collect())) == sorted(map(tuple, want.select("k", "rank").collect()))


def test_prefix_scan_max(spark):
    rnd = random.Random(3)
    rows = [("r", i, float(rnd.random())) for i in range(500)] + [("s", i, float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "run string, step long, value double")
    got = prefix_scan(df, ["run"], [F.col("step")], numeric_bucket(df, "step", 16), "value", "max", name="m")
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("m", F.max("value").over(w))
    assert sorted(map(tuple, got.select("run", "step", "m").collect()), key=repr) == \
        sorted(map(tuple, want.select("run", "step", "m").collect()), key=repr)


def _py_early_stop(vals, p, d):
    best, bad = None, 0
    for s, v in vals:
        if best is None or best - v > d:
            best, bad = v, 0
        else:
            bad += 1
        if bad >= p:
            return s, best
    return None, best


def test_early_stop_matches_sequential_fold(spark):
    from pairlab.operators.training_log import early_stop_step
    rnd = random.Random(11)
    rows, want = [], {}
    for run in range(6):
        n = 400 if run == 0 else rnd.randint(1, 40)  # run 0 is the hot run
        v, vals = 10.0, []
        for s in range(1, n + 1):
            v = v - rnd.choice([0.0, 0.005, 0.02, 0.5]) + (0.3 if rnd.random() < 0.05 else 0.0)
            vals.append((s * 10, round(v, 4)))
            rows.append((run, "loss", s * 10, round(v, 4)))
        want[run] = _py_early_stop(vals, 3, 0.01)
    df = spark.createDataFrame(rows, "run long, metric string, step long, value double")
    got = {r["run"]: (r["stop_step"], r["best_value"])
           for r in early_stop_step(df, patience=3, threshold=0.01, steps_per_bucket=7).collect()}
    for run, (stop, best) in want.items():
        assert got[run][0] == stop
        assert abs(got[run][1] - best) < 1e-9


def test_exact_quantiles_match_pandas(spark):
    import pandas as pd

    from pairlab.operators.profile import exact_quantiles
    rnd = random.Random(9)
    rows = [("hot" if i % 3 else f"g{i % 7}", rnd.random() * 100, float(rnd.randint(0, 5))) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], ["x", "y"], [0.5, 0.95, 0.99]).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    for g, part in pdf.groupby("g"):
        for c in ("x", "y"):
            for q in (0.5, 0.95, 0.99):
                assert abs(got[g][f"{c}_p{int(q * 100)}"] - part[c].quantile(q)) < 1e-9


def test_percentiles_and_histogram_on_doubles(spark):
    from pyspark.sql import functions as F

    from pairlab.operators.profile import length_histogram, length_percentiles
    rnd = random.Random(4)
    rows = [("a" if i % 4 else "b", rnd.random() * 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, x double")
    p_rank = {r["g"]: r for r in length_percentiles(df, "x", by=["g"]).collect()}
    p_map = {r["g"]: r for r in df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.5), F.lit(0.99))).alias("p"))
             .collect()}
    for g in ("a", "b"):
        assert abs(p_rank[g]["p50"] - p_map[g]["p"][0]) < 1e-9 and abs(p_rank[g]["p99"] - p_map[g]["p"][1]) < 1e-9
    h = length_histogram(df, "x", bins=10, by=["g"])
    assert h.groupBy("g").agg(F.sum("n").alias("n")).orderBy("g").collect()[0]["n"] == 750


def test_ranked_global_and_totals(spark):
    from pyspark.sql import functions as F
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"), F.lit("g").alias("g"))
    got = ranked(df, [], [F.col("x")], numeric_bucket(df, "x", 16), name="r", total="n")
    rows = got.collect()
    assert sorted(r["r"] for r in rows) == list(range(1, 501))
    assert all(r["r"] == r["x"] + 1 for r in rows) and {r["n"] for r in rows} == {500}
    top = ranked(df, ["g"], [F.col("x")], numeric_bucket(df, "x", 16), name="r", limit=7).collect()
    assert sorted(r["x"] for r in top) == list(range(7))
