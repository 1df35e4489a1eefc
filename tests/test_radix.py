"""Range buckets by measured prefix counts; vocabulary ids against a plain rank."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlab.operators import examples as X
from pairlab.operators.radix import descending, radix_prefixes
from pairlab.session import cut_lineage


def test_tokens_that_share_their_start(spark):
    """A million distinct tokens with the same first characters, seen once each, and some frequent ones."""
    n = 1_000_000
    rows = spark.range(n).select(F.concat(F.lit("zz"), F.md5(F.col("id").cast("string"))).alias("token"), F.lit(1).cast("bigint").alias("n"))
    rows = rows.union(spark.range(500).select(F.concat(F.lit("the"), "id"), 1000 - F.col("id")))
    rows = cut_lineage(rows.withColumn("k", descending("n", "token")))
    leaves = cut_lineage(radix_prefixes(rows, "k", 256))
    sizes = leaves.groupBy("_prefix").count()
    assert sizes.agg(F.max("count")).first()[0] <= -(-(n + 500) // 256)
    assert sizes.count() < 40 * 256
    # non-decreasing along the keys: leaves don't overlap and follow each other
    spans = leaves.groupBy("_prefix").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    w = Window.orderBy("_prefix")
    assert spans.withColumn("before", F.lag("high").over(w)).filter("before >= low").count() == 0


def test_odd_keys(spark):
    keys = ["", "a", "a", "a", "ab", "abc", "abc\u0000", "é", "𝒳", "𝒳y", "zebra"] * 3 + [f"common start {i}" for i in range(50)]
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [(r.k, r["_prefix"]) for r in radix_prefixes(rows, "k", 16).collect()]
    assert len(got) == len(keys) and all(k.startswith(p) for k, p in got)
    ordered = sorted(got, key=lambda x: x[0].encode())
    assert [p for _, p in ordered] == sorted((p for _, p in ordered), key=str.encode)
    assert radix_prefixes(rows.limit(0), "k").count() == 0


def test_ids_equal_a_plain_rank_and_texts_come_back(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["der", "die", "é", "!"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (902, "unseen words here")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    vocab = X.build_vocab(df.filter("id < 900"), "text").collect()
    ordered = sorted(vocab, key=lambda r: (-r.n, r.token.encode()))
    assert [r.id for r in ordered] == list(range(2, len(vocab) + 2))
    ids = {r.token: r.id for r in vocab}
    table = spark.createDataFrame(vocab)
    for cut in (None, 7):
        got = {r.id: (r.input_ids, r.size) for r in X.tokenize(df.withColumn("size", F.lit(4)), ["id"], "text", table, cut, carry=["size"]).collect()}
        for i, text in rows:
            assert got[i] == ([ids.get(t, 1) for t in (text or "").split()][:cut], 4)
