"""Record files packed and pruned in the listing; co-partitioned tables without an exchange."""

import json
import os

from pyspark.sql import functions as F

from pairlab.operators import corpus as C
from pairlab.sources import layout as LO
from pairlab.sources import readers as R
from pairlab.sources import record_files as RF


def write(root, language, name, body):
    os.makedirs(os.path.join(root, language), exist_ok=True)
    with open(os.path.join(root, language, name), "w") as f:
        f.write(body)


def test_many_small_files_are_few_tasks(spark, tmp_path):
    root = str(tmp_path)
    for i in range(10_000):
        write(root, "en" if i % 3 else "de", f"{i:05d}.json", json.dumps({"title": f"t{i}", "text": "x" * (i % 50), "url": "u"}))
    raw = RF.record_files(spark, root)
    assert raw.rdd.getNumPartitions() < 60
    good, bad = R.read_articles(spark, root)
    assert good.count() == 10_000 and bad.count() == 0
    assert {(r.article_id, r.language, r.title) for r in good.filter("article_id = '00007'").collect()} == {("00007", "en", "t7")}


def test_filters_narrow_the_listing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for lang in ("en", "fr"):
        for i in range(6):
            write(root, lang, f"{i}.json", json.dumps({"title": f"{lang}{i}", "text": "body"}))
    write(root, "en", "_completed.json", "[]")
    write(root, "en", "notes.txt", "no record")
    write(root, "_tmp", "7.json", "{}")
    reader = RF.RecordReader({"path": root, "ids": "2\n5\nmissing", "languages": "fr"})
    assert [f for p in reader.partitions() for f in p.files] == [("fr", "2", f"{root}/fr/2.json"), ("fr", "5", f"{root}/fr/5.json")]
    left = list(RF.PushingReader({"path": root}).pushFilters([RF.In(("id",), ("1", None)), RF.EqualTo(("path",), "x")]))
    assert left == [RF.EqualTo(("path",), "x")]
    # files that are not asked for are not opened: a broken one among them does no harm
    os.remove(os.path.join(root, "fr", "3.json"))
    os.symlink("/nowhere", os.path.join(root, "fr", "3.json"))
    got, _ = R.read_articles(spark, root, languages=["fr"], ids=["0", "4"])
    assert sorted((r.article_id, r.language, r.title) for r in got.collect()) == [("0", "fr", "fr0"), ("4", "fr", "fr4")]
    assert R.read_articles(spark, root, ids=[])[0].count() == 0
    assert R.read_articles(spark, root)[0].filter("language = 'fr' and article_id in ('1', '5')").count() == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        assert R.read_articles(spark, root, languages=["fr"], ids=["1"])[0].count() == 1
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert R.read_articles(spark, "file:" + root, languages=["en"])[0].count() == 6


def test_a_large_file_is_alone_and_an_empty_root_is_empty(spark, tmp_path):
    files = [(("en", str(i), "p"), s) for i, s in enumerate((10, 900, 10, 10))]
    assert [len(p.files) for p in RF.pack(files, 100, 1)] == [1, 1, 2]
    assert R.read_summaries(spark, str(tmp_path / "none"))[0].count() == 0


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def test_copartitioned_joins_have_no_exchange(spark, tmp_path):
    articles = spark.range(500).select(F.concat(F.lit("a"), F.col("id") % 400).alias("article_id"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("language"),
                                       F.concat(F.lit("text "), "id").alias("text"), F.lit("t").alias("title"))
    summaries = articles.filter("article_id < 'a3'").select("article_id", "language", F.lit("short").alias("summary")).distinct()
    LO.save_copartitioned(articles, "copart_articles", str(tmp_path / "articles"), 8)
    LO.save_copartitioned(summaries, "copart_summaries", str(tmp_path / "summaries"), 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, s = LO.open_copartitioned(spark, "copart_articles"), LO.open_copartitioned(spark, "copart_summaries")
        for op in (C.join_article_summary, C.join_audit):
            joined, plain = op(a, s), op(articles, summaries)
            assert exchanges(joined) == 0 < exchanges(plain)
            assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))
        keys = ["article_id", "language"]
        todo, want = LO.not_null(a, keys).join(LO.not_null(s.select(*keys), keys), keys, "left_anti"), C.resume_anti_join(articles, summaries, keys)
        assert exchanges(todo) == 0 and todo.count() == want.count()
        assert C.resume_anti_join(a, s, keys).count() == want.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table copart_articles")
        spark.sql("drop table copart_summaries")
