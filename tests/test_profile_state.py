"""Profiles that grow with their files: quantiles as from scratch, only new files read."""

import os
import random

from pyspark.sql import functions as F

from pairlab.operators import profile as PR
from pairlab.operators.profile_state import ProfileState
from pairlab.plans.flagships import profile_corpus

SCHEMA = "language string, split string, text string, summary string"


def rows_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def made(rng, n):
    text = lambda k: " ".join(rng.choice(["a", "bb", "ccc", "d."]) for _ in range(rng.randint(0, k)))
    return [(rng.choice(["en", "de", None]), rng.choice(["train", "test"]), text(60) if rng.random() < 0.95 else None, text(9)) for _ in range(n)]


def test_states_merge_to_the_whole_profile(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path / "data")
    state, every = ProfileState(spark, str(tmp_path / "state")), []
    for k, n in enumerate((200, 1, 90)):
        part = made(rng, n)
        every += part
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(root)
        before = {f for f in os.listdir(root) if f.endswith(".parquet")}
        added = state.add(root, SCHEMA)
        assert added == len(before) - (state._all("files").count() - added) > 0
        assert state.add(root, SCHEMA) == 0 and state.runs() == k + 1
        assert rows_of(state.profile()) == rows_of(profile_corpus(spark.createDataFrame(every, SCHEMA)))
    # texts are not read again: the state is whole without the files
    for f in os.listdir(root):
        os.remove(os.path.join(root, f))
    assert rows_of(state.profile()) == rows_of(profile_corpus(spark.createDataFrame(every, SCHEMA)))


def test_an_interrupted_run_counts_for_nothing(spark, tmp_path):
    rng, root = random.Random(5), str(tmp_path / "data")
    state, part = ProfileState(spark, str(tmp_path / "state")), made(rng, 50)
    spark.createDataFrame(part, SCHEMA).write.parquet(root)
    spark.createDataFrame(part[:3], SCHEMA).write.parquet(state._path("features", 0))  # what a lost run left
    assert state.runs() == 0 and state.add(root, SCHEMA) > 0
    assert rows_of(state.profile()) == rows_of(profile_corpus(spark.createDataFrame(part, SCHEMA)))


def test_given_split_points_change_no_quantile(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.choice(["x", None]), rng.gauss(0, 1)) for _ in range(500)] + [("y", None), ("x", 0.0), ("x", 0.0)], "g string, v double")
    points = spark.createDataFrame([("x", "v", [-1.0, 0.0, 1.0]), (None, "v", [])], "g string, _c string, points array<double>")
    a, b = (rows_of(PR.exact_quantiles(df, ["g"], ["v"], [0.1, 0.5, 0.99], p)) for p in (None, points))
    assert a == b
