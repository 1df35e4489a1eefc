"""Readers/writers on the reference's file layouts and incremental jobs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pairlab.operators import generate as G
from pairlab.sources import readers as R
from pairlab.sources import writers as W
from pairlab.streaming import incremental as INC


def _write(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj, ensure_ascii=False))


def test_read_articles_and_quarantine(spark, tmp_path):
    root = str(tmp_path / "raw")
    _write(f"{root}/en/abc.json", {"title": "T", "text": "body", "url": "u", "pageid": 1})
    _write(f"{root}/fr/def.json", {"title": "Té"})  # missing keys -> ""
    _write(f"{root}/fr/bad.json", "{not json")
    good, bad = R.read_articles(spark, root)
    rows = {(r["article_id"], r["language"]): r for r in good.collect()}
    assert rows[("abc", "en")]["text"] == "body"
    assert rows[("def", "fr")]["text"] == "" and rows[("def", "fr")]["title"] == "Té"
    assert ("bad", "fr") not in rows
    assert [r["path"].endswith("bad.json") for r in bad.collect()] == [True]


def test_read_summaries_skips_tracking(spark, tmp_path):
    root = str(tmp_path / "sum")
    _write(f"{root}/en/abc.json", {"article_id": "abc", "language": "en", "summary": "S", "title": "T"})
    _write(f"{root}/en/xyz.json", {"article_id": "xyz", "language": "en", "title": "T"})
    _write(f"{root}/en/_completed.json", {"completed_article_ids": ["abc", "xyz"], "total_completed": 2})
    good, bad = R.read_summaries(spark, root)
    got = sorted((r["article_id"], r["summary"]) for r in good.collect())
    assert got == [("abc", "S"), ("xyz", "")] and bad.count() == 0


def test_article_index(spark, tmp_path):
    p = str(tmp_path / "index.json")
    with pytest.raises(FileNotFoundError):
        R.read_article_index(spark, p)
    _write(p, [{"id": "a1", "titles": {"en": "X", "fr": "Y"}, "urls": {"en": "ux"}}])
    r = R.read_article_index(spark, p).first()
    assert r["titles"] == {"en": "X", "fr": "Y"}


def test_index_last_wins(spark, tmp_path):
    df = spark.createDataFrame([("a", "en", "old", "u1"), ("a", "en", "new", "u2"), ("a", "fr", "fr", "u3")],
                               "id string, language string, title string, url string").coalesce(1)
    df = df.withColumn("pos", F.when(F.col("title") == "old", 0).otherwise(1))  # rows carry their position
    r = W.index_table(df, position="pos").first()
    assert r["titles"] == {"en": "new", "fr": "fr"}


def test_split_dataset_roundtrip(spark, tmp_path):
    root = str(tmp_path / "ds")
    df = spark.createDataFrame([("a", "en", "train"), ("b", "en", "test"), ("c", "fr", "train")],
                               "article_id string, language string, split string")
    W.write_split_dataset(df, root)
    got = R.read_split_dataset(spark, root, "en", "train").select("article_id").collect()
    assert [r[0] for r in got] == ["a"]
    one_lang = str(tmp_path / "fr_only")
    df.filter("language = 'fr'").drop("language").write.parquet(one_lang)
    assert R.read_split_dataset(spark, one_lang, "fr").first()["language"] == "fr"


def test_comparisons_and_judge_files(spark, tmp_path):
    p = str(tmp_path / "cmp.json")
    _write(p, {"config": {"language": "fr"}, "comparisons": [
        {"index": 5, "title": "A", "reference_summary": "r", "base_model_summary": "b"},
        {"index": 6, "title": "B"}], "average_metrics": {}})
    rows = R.read_comparisons(spark, p, 1).collect()
    assert len(rows) == 1 and rows[0]["finetuned_model_summary"] == "" and rows[0]["index"] == 5
    j = str(tmp_path / "judge" / "x.json")
    _write(j, {"model": "judge", "config": {"language": "fr", "subset": "test"},
               "evaluation_results": [{"index": 1, "title": "t", "base_score": 2, "finetuned_score": 4,
                                       "explanation": "e", "improvement": 2},
                                      {"index": 2, "title": "u", "base_score": None, "finetuned_score": 3,
                                       "explanation": "Failed to parse response", "improvement": None}]})
    jr = R.read_judge_results(spark, str(tmp_path / "judge" / "*.json"))
    assert jr.count() == 2 and jr.filter(F.col("base_score").isNull()).count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5, 0.25)], "model string, rouge1_f double, rouge2_f double")
    W.write_metrics_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).schema(df.schema).csv(str(tmp_path / "csv"))
    assert back.collect() == df.collect()
    W.write_comparison_report(df, str(tmp_path / "rep"), {"k": 1}, df)
    hdr = spark.read.json(str(tmp_path / "rep" / "header")).first()
    assert json.loads(hdr["config"]) == {"k": 1}
    meta = W.run_metadata(spark.createDataFrame([("en", "train"), ("fr", "test")], "language string, split string"),
                          {"seed": 1}, "now").first()
    assert meta["total_rows"] == 2 and meta["languages"] == ["en", "fr"] and meta["ratio_train"] == 0.5


def test_rewrite_in_place(spark, tmp_path):
    src = str(tmp_path / "t")
    spark.createDataFrame([("a\nb",)], "summary string").write.parquet(src)
    from pairlab.plans.flagships import clean_summaries
    W.rewrite_or_copy(clean_summaries(spark.read.parquet(src)), src)
    assert spark.read.parquet(src).first()["summary"] == "a"


def test_incremental_ingest_twice(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([("p1", 1), ("p2", 2), ("p1", 3)], "name string, v long").write.parquet(src + "/b1")
    schema = "name string, v long"
    INC.incremental_ingest(spark, src + "/*", schema, "name", ck, out).awaitTermination()
    n1 = spark.read.parquet(out).count()
    INC.incremental_ingest(spark, src + "/*", schema, "name", ck, out).awaitTermination()
    assert n1 == 2 and spark.read.parquet(out).count() == 2
    spark.createDataFrame([("p3", 4), ("p2", 5)], schema).write.parquet(src + "/b2")
    INC.incremental_ingest(spark, src + "/*", schema, "name", ck, out).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(out).select("name").collect()) == ["p1", "p2", "p3"]


def test_incremental_generate_idempotent(spark, tmp_path):
    out = str(tmp_path / "gen")
    todo = spark.createDataFrame([("a", "en", "One. Two. Three."), ("b", "fr", "Un. Deux.")],
                                 "article_id string, language string, prompt string")
    n1 = INC.incremental_generate(spark, todo, ["article_id", "language"], G.lead_sentences(2), out)
    n2 = INC.incremental_generate(spark, todo, ["article_id", "language"], G.lead_sentences(2), out)
    assert (n1, n2) == (2, 0)
    assert sorted(r["generated"] for r in spark.read.parquet(out).collect()) == ["One. Two.", "Un. Deux."]


def test_generate_failure_policies(spark):
    def make():
        def gen(prompts):
            if any(p == "boom" for p in prompts):
                raise RuntimeError("bad input")
            return [p.upper() for p in prompts]
        return gen
    df = spark.createDataFrame([("1", "ok"), ("2", "boom")], "k string, prompt string")
    skip = {r["k"]: r["generated"] for r in G.generate_batch(df, make, on_error="skip").collect()}
    msg = {r["k"]: r["generated"] for r in G.generate_batch(df, make, on_error="message").collect()}
    empty = {r["k"]: r["generated"] for r in G.generate_batch(df, make, on_error="empty").collect()}
    assert skip == {"1": "OK"}
    assert msg == {"1": "OK", "2": "Error generating summary"}
    assert empty == {"1": "OK", "2": ""}


def test_incremental_generate_stream(spark, tmp_path):
    src, out, ck = str(tmp_path / "todo"), str(tmp_path / "gen"), str(tmp_path / "ck")
    schema = "article_id string, language string, prompt string"
    spark.createDataFrame([("a", "en", "One. Two. Three.")], schema).write.parquet(src + "/b1")
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(src + "/*")
        INC.incremental_generate_stream(stream, ["article_id", "language"], G.lead_sentences(1), out, ck)\
            .awaitTermination()
    spark.createDataFrame([("b", "fr", "Un. Deux."), ("a", "en", "One. Two. Three.")], schema).write.parquet(src + "/b2")
    stream = spark.readStream.schema(schema).parquet(src + "/*")
    INC.incremental_generate_stream(stream, ["article_id", "language"], G.lead_sentences(1), out, ck).awaitTermination()
    got = sorted((r["article_id"], r["generated"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", "One."), ("b", "Un.")]


def test_incremental_ingest_with_watermark(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "name string, ts timestamp"
    spark.sql("select 'p1' as name, timestamp'2024-01-01 00:00:00' as ts union all "
              "select 'p1', timestamp'2024-01-01 00:00:05' union all "
              "select 'p2', timestamp'2024-01-01 00:00:07'").write.parquet(src + "/b1")
    q = INC.incremental_ingest(spark, src + "/*", schema, "name", ck, out, watermark=("ts", "1 hour"))
    q.awaitTermination()
    assert sorted(r["name"] for r in spark.read.parquet(out).collect()) == ["p1", "p2"]


def test_record_lines_with_bad_line(spark, tmp_path):
    root = str(tmp_path / "lines")
    df = spark.createDataFrame([("a", "en", "T", "one\ntwo\r three", None), ("b", "fr", "", "x", "u")],
                               "article_id string, language string, title string, text string, url string")
    W.write_records(df, root)
    with open(f"{root}/language=fr/more.json", "w", encoding="utf-8") as f:
        f.write('{"article_id": "c", "text": "t"}\n{broken\n')
    good, bad = R.read_articles(spark, root, layout="lines")
    got = sorted((r.article_id, r.language, r.title, r.text, r.url) for r in good.collect())
    assert got == [("a", "en", "T", "one\ntwo\r three", ""), ("b", "fr", "", "x", "u"), ("c", "fr", "", "t", "")]
    assert [r.record for r in bad.collect()] == ["{broken"]
    with pytest.raises(ValueError):
        R.read_articles(spark, root, layout="other")


def test_pair_dataset_from_files_to_files(spark, tmp_path):
    from pairlab.plans import flagships as FL
    at = lambda name: str(tmp_path / name)
    a = spark.createDataFrame([(f"{i:02x}", l, f"t{i}", " " if i == 3 else f"text {i}", "u") for i in range(40) for l in ("en", "fr")],
                              "article_id string, language string, title string, text string, url string")
    s = a.selectExpr("article_id", "language", "case when article_id = '05' then '' else title end as summary", "title")
    W.write_index(a.withColumnRenamed("article_id", "id"), at("index"))
    W.write_records(a, at("articles"))
    W.write_records(s, at("summaries"))
    got = FL.build_pair_dataset_files(spark, at("index"), at("articles"), at("summaries"), at("out"), "now",
                                      max_articles=30, per_language=20).collect()
    assert sorted((r.article_id, r.language) for r in got) == sorted(
        (f"{i:02x}", l) for i in range(22) if i not in (3, 5) for l in ("en", "fr"))
    for lang in ("en", "fr"):
        splits = [r.split for r in got if r.language == lang]
        assert [splits.count(x) for x in ("train", "validation", "test")] == [16, 2, 2]
    meta = spark.read.json(at("out/metadata")).first()
    assert meta.total_rows == 40 and meta.article_counts.asDict() == {"en": 20, "fr": 20} and meta.fields == FL.FIELDS
    assert json.loads(meta.config)["max_articles"] == 30


def test_judge_documents(spark, tmp_path):
    from pairlab.operators import generate as G
    from pairlab.plans import flagships as FL
    for lang, n in (("en", 3), ("fr", 1)):
        _write(str(tmp_path / "cmp" / f"{lang}.json"), {"config": {"language": lang}, "comparisons": [
            {"index": i, "title": f"t{i}", "reference_summary": "a b c", "base_model_summary": "x",
             "finetuned_model_summary": "a b c" if i else "y"} for i in range(n)]})
    stats = FL.judge_report_files(spark, str(tmp_path / "cmp"), str(tmp_path / "out"), G.overlap_judge(), "overlap", n=2,
                                  json_lines=False)
    got = {r.config["language"]: (r.valid_evaluations, r.win_rate, r.tie_rate) for r in stats.collect()}
    assert got == {"en": (2, 0.5, 0.5), "fr": (1, 0.0, 1.0)}
    back = R.read_judge_results(spark, str(tmp_path / "out"), json_lines=True)
    assert sorted((r.language, r["index"]) for r in back.collect()) == [("en", 0), ("en", 1), ("fr", 0)]


def test_clean_summary_files_in_place(spark, tmp_path):
    from pairlab.plans import flagships as FL
    root = str(tmp_path / "s")
    df = spark.createDataFrame([("a", "en", "x\ny", "T"), ("b", "fr", "", "U")],
                               "article_id string, language string, summary string, title string")
    W.write_records(df, root)
    assert FL.clean_summary_files(spark, root) == root
    got = sorted(tuple(r) for r in R.read_summaries(spark, root, layout="lines")[0].collect())
    assert got == [("a", "en", "x", "T"), ("b", "fr", "", "U")]
