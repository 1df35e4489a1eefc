"""Keyed ingest state, stored key filters, null keys and ties."""

import os
import random

from pyspark.sql import functions as F

from pairlab.operators import corpus as C
from pairlab.operators import generate as G
from pairlab.operators import key_filter as KF
from pairlab.streaming import incremental as INC

SCHEMA = "name string, pos bigint, text string"


def run(spark, base):
    q = INC.incremental_ingest(spark, os.path.join(base, "in"), SCHEMA, "name", os.path.join(base, "ck"), os.path.join(base, "out"), order="pos")
    q.awaitTermination()
    return sorted(((r.name, r.pos, r.text) for r in spark.read.parquet(os.path.join(base, "out")).collect()), key=str)


def test_three_batches_out_of_order(spark, tmp_path):
    rng, base = random.Random(1), str(tmp_path)
    kept = {}
    for k in range(3):
        rows = [(rng.choice(["a", "b", "c", "d", "e", None, f"only{k}"]), rng.randrange(100) if rng.random() < 0.9 else None, f"t{k}-{i}") for i in range(12)]
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(os.path.join(base, "in"))
        batch = {}
        for r in rows:
            place = (r[1] is not None, r[1] or 0, f"Row(name={r[0]!r}, pos={r[1]!r}, text={r[2]!r})")
            if r[0] not in batch or place < batch[r[0]][0]:
                batch[r[0]] = (place, r)
        for name, (_, r) in batch.items():
            kept.setdefault(name, r)
        assert run(spark, base) == sorted(kept.values(), key=str)
    # a replayed batch adds nothing: its commit is lost, its output is there
    for f in os.listdir(os.path.join(base, "ck", "commits")):
        if f.strip(".").split(".")[0] == "2":
            os.remove(os.path.join(base, "ck", "commits", f))
    assert run(spark, base) == sorted(kept.values(), key=str)
    q = [f for f in os.listdir(os.path.join(base, "ck", "state")) if not f.startswith(".")]
    assert q  # the keys are state, not read from the output


def test_filtered_anti_join_equals_the_plain_one(spark):
    rng = random.Random(2)
    key = lambda: (rng.choice(["x", "y", None]), rng.choice([*range(40), None]))
    todo = spark.createDataFrame([(*key(), i) for i in range(300)], "a string, b int, i int")
    done = spark.createDataFrame([key() for _ in range(40)], "a string, b int")
    seen = {(r.a, r.b) for r in done.collect()}
    want = sorted(r.i for r in todo.collect() if (r.a, r.b) not in seen)
    for bits in (15, 16, 25):
        got = C.resume_anti_join(todo, done, ["a", "b"], KF.key_pages(done, ["a", "b"], 27) if bits == 25 else None)
        assert sorted(r.i for r in got.collect()) == want
        assert sorted(r.i for r in KF.filtered_anti_join(todo, done, ["a", "b"], KF.key_pages(done, ["a", "b"], bits), bits).collect()) == want
    assert C.pending_keys(todo, done, ["a", "b"]).count() == len({(r.a, r.b) for r in todo.collect()} - seen)
    # the finished keys are not shuffled whole: no exchange of theirs without the filter below it
    plan = KF.filtered_anti_join(todo, done, ["a", "b"], KF.key_pages(done, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_filters_merge_over_runs(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(f"k{i}" if i % 10 else None, i % 7, f"text {i}. More") for i in range(60)]
    todo = spark.createDataFrame(rows, "a string, b int, prompt string").dropDuplicates(["a", "b"])
    n = todo.count()
    half = todo.filter("b < 3")
    first = INC.incremental_generate(spark, half, ["a", "b"], G.lead_sentences(1), out)
    assert first == half.count() > 0
    assert INC.incremental_generate(spark, half, ["a", "b"], G.lead_sentences(1), out) == 0  # null keys included
    assert INC.incremental_generate(spark, todo, ["a", "b"], G.lead_sentences(1), out) == n - first
    assert INC.incremental_generate(spark, todo, ["a", "b"], G.lead_sentences(1), out) == 0
    assert spark.read.parquet(out).count() == n
    held = KF.KeyFilter(spark, out, ("a", "b"))
    assert len(held._generations()) == 1
    # someone else appends: the filter is made anew and covers them
    spark.createDataFrame([("new", 1, "x")], "a string, b int, generated string").write.mode("append").parquet(out)
    more = todo.union(spark.createDataFrame([("new", 1, "y")], todo.schema))
    assert INC.incremental_generate(spark, more, ["a", "b"], G.lead_sentences(1), out) == 0


def test_samples_with_equal_keys_agree(spark):
    rows = [(i % 3, i % 2, f"t{i}") for i in range(200)]
    a = spark.createDataFrame(rows, "k int, l int, t string").repartition(3)
    b = spark.createDataFrame(rows[::-1], "k int, l int, t string").repartition(7)
    for key in ("k", ["k", "l"]):
        x, y = (sorted(map(tuple, C.seeded_sample(d, 20, 1, key).collect())) for d in (a, b))
        assert x == y and len(x) == 20
    assert C.sample_without_replacement(a, 500, 1, "k").count() == 200


def test_null_bucket_keeps_its_rows(spark):
    from pairlab.operators.ranking import ranked
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "x int, b string")
    got = {r.x: r["rank"] for r in ranked(df, [], [F.col("b"), F.col("x")], F.col("b")).collect()}
    assert got == {1: 1, 3: 2, 2: 3}
