"""Readers for the reference's on-disk layouts.

* article index      -- one JSON array of {id, titles{lang: title}, urls{lang: url}}
* articles/summaries -- one JSON object per file at ``{root}/{lang}/{id}.json``
* split dataset      -- Parquet partitioned by language and split
* comparison / judge result files -- one nested JSON document per file

Every read declares its schema.  Record files are listed by language and id and
packed by size (``record_files``); language and id come from their paths.
Malformed files are not dropped silently: they are routed to a quarantine
DataFrame next to the good rows.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.sources.record_files import reachable, record_files

INDEX_SCHEMA = "id STRING, titles MAP<STRING, STRING>, urls MAP<STRING, STRING>"
ARTICLE_SCHEMA = "article_id STRING, title STRING, text STRING, url STRING, pageid BIGINT, _corrupt_record STRING"
SUMMARY_SCHEMA = "article_id STRING, language STRING, summary STRING, title STRING, _corrupt_record STRING"
COMPLETED_FILE = "_completed.json"
# "reference": one record per file at {language}/{id}.json; "lines": the distributed form,
# JSON lines in language=*/ folders with the id in the record (files grow with bytes, not rows)
LAYOUTS = ("reference", "lines")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_article_index(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Index rows (id, titles, urls); an error when the file is missing.

    The reference writes one JSON array; ``json_lines=True`` reads the
    distributed form written by ``write_index`` (one object per line).
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"article index not found: {path}")
    return spark.read.schema(INDEX_SCHEMA).option("multiLine", not json_lines).json(path)


def _record_json(spark: SparkSession, root: str, schema: str, layout: str = "reference",
                 languages: Sequence[str] | None = None, ids: Sequence[str] | None = None) -> DataFrame:
    """One row per record under ``root``, parsed with ``schema``.

    In the reference layout files are read whole, language and id come from the
    path (``record_files``; by Spark's text source where only Spark reaches the store); in the lines
    layout a record is a line, its id is in the record and its language is the folder's.
    A malformed record keeps its text in ``_corrupt_record``.
    """
    if layout not in LAYOUTS:
        raise ValueError(layout)
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    if layout == "reference" and reachable(root):
        raw = record_files(spark, root, languages, ids)
        return raw.select(F.col("path").alias("_path"), F.col("language").alias("_language"), F.col("id").alias("_id"), parsed.alias("_j")).select(
            "_path", "_language", "_id", "_j.*")
    whole = layout == "reference"
    raw = (spark.read.option("wholetext", whole).option("pathGlobFilter", "*.json")
           .text(os.path.join(root, "*", "*.json") if whole else os.path.join(root, "language=*"))
           .withColumn("_path", F.col("_metadata.file_path"))
           .filter(~F.col("_path").endswith("/" + COMPLETED_FILE)))
    rows = raw.select("_path", parsed.alias("_j")).select("_path", "_j.*")
    place = r"([^/]+)/([^/]+)\.json$" if whole else r"language=([^/]+)/([^/]+)$"
    rows = (rows.withColumn("_language", F.regexp_extract("_path", place, 1))
            .withColumn("_id", F.regexp_extract("_path", place, 2) if whole else F.col("article_id")))
    if languages is not None:
        rows = rows.filter(F.col("_language").isin(list(languages)))
    return rows if ids is None else rows.filter(F.col("_id").isin(list(ids)))


def read_articles(spark: SparkSession, root: str, layout: str = "reference", languages: Sequence[str] | None = None,
                  ids: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, quarantine).  Articles: (article_id, language, title, text,
    url) with absent keys as ""; quarantine: (path, record) of bad files.
    ``languages`` and ``ids`` restrict what is listed and opened."""
    return _good_and_bad(_record_json(spark, root, ARTICLE_SCHEMA, layout, languages, ids), ("title", "text", "url"))


def read_summaries(spark: SparkSession, root: str, layout: str = "reference", languages: Sequence[str] | None = None,
                   ids: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(summaries, quarantine): (article_id, language, summary, title) with absent
    keys as ""; the tracking file is skipped."""
    return _good_and_bad(_record_json(spark, root, SUMMARY_SCHEMA, layout, languages, ids), ("summary", "title"))


def _good_and_bad(raw: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    good = raw.filter(F.col("_corrupt_record").isNull()).select(
        F.col("_id").alias("article_id"), F.col("_language").alias("language"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields])
    bad = raw.filter(F.col("_corrupt_record").isNotNull()).select(F.col("_path").alias("path"),
                                                                  F.col("_corrupt_record").alias("record"))
    return good, bad


def read_split_dataset(spark: SparkSession, root: str, language: str | None = None,
                       split: str | None = None) -> DataFrame:
    """Load the (language, split) dataset; the filters prune partitions.

    When ``root`` holds one language's dataset (no ``language=`` level), it
    is read as is and tagged with ``language``.
    """
    df = spark.read.parquet(root)
    if language is not None:
        if "language" in df.columns:
            df = df.filter(F.col("language") == language)
        else:
            df = df.withColumn("language", F.lit(language))
    if split is not None and "split" in df.columns:
        df = df.filter(F.col("split") == split)
    return df


COMPARISON_SCHEMA = """
config MAP<STRING, STRING>,
comparisons ARRAY<STRUCT<index: BIGINT, title: STRING, text: STRING, reference_summary: STRING,
                         base_model_summary: STRING, finetuned_model_summary: STRING,
                         base_metrics: MAP<STRING, DOUBLE>, finetuned_metrics: MAP<STRING, DOUBLE>>>
"""


def read_comparisons(spark: SparkSession, path: str, n: int | None = None, json_lines: bool = False) -> DataFrame:
    """First ``n`` comparison rows of each comparison document, with "" defaults and
    the run's config as columns.  The reference writes one document per file;
    ``json_lines=True`` reads one per line."""
    raw = spark.read.schema(COMPARISON_SCHEMA).option("multiLine", not json_lines).json(path)
    ex = raw.select("config", F.posexplode("comparisons").alias("pos", "c"))
    if n is not None:
        ex = ex.filter(F.col("pos") < n)
    text_cols = ["title", "text", "reference_summary", "base_model_summary", "finetuned_model_summary"]
    return ex.select("pos", F.col("c.index").alias("index"),
                     *[F.coalesce(F.col(f"c.{k}"), F.lit("")).alias(k) for k in text_cols],
                     F.col("c.base_metrics").alias("base_metrics"), F.col("c.finetuned_metrics").alias("finetuned_metrics"),
                     F.col("config"))


JUDGE_SCHEMA = """
model STRING,
config MAP<STRING, STRING>,
evaluation_results ARRAY<STRUCT<index: BIGINT, title: STRING, base_score: DOUBLE, finetuned_score: DOUBLE,
                                explanation: STRING, improvement: DOUBLE>>,
statistics STRUCT<average_base_score: DOUBLE, average_finetuned_score: DOUBLE, average_improvement: DOUBLE,
                  win_rate: DOUBLE, tie_rate: DOUBLE, loss_rate: DOUBLE, valid_evaluations: BIGINT,
                  total_evaluations: BIGINT, error: STRING>
"""


def _judge_documents(spark: SparkSession, pattern: str, json_lines: bool) -> DataFrame:
    return spark.read.schema(JUDGE_SCHEMA).option("multiLine", not json_lines).json(pattern)


def read_judge_statistics(spark: SparkSession, pattern: str, json_lines: bool = False) -> DataFrame:
    """The statistics of judge result documents: one row per run, with its config."""
    return _judge_documents(spark, pattern, json_lines).select(F.col("model").alias("judge_model"), "config", "statistics.*")


def read_judge_results(spark: SparkSession, pattern: str, json_lines: bool = False) -> DataFrame:
    """Many judge result documents -> one row per judged pair, tagged with the
    judge model, run config (language, subset, models) and file name.  The
    reference writes one document per file; ``json_lines=True`` reads one per line."""
    raw = _judge_documents(spark, pattern, json_lines)
    ex = raw.select("model", "config", F.col("_metadata.file_name").alias("file"),
                    F.explode("evaluation_results").alias("r"))
    return ex.select(F.col("model").alias("judge_model"), "file",
                     F.col("config")["language"].alias("language"), F.col("config")["subset"].alias("subset"),
                     F.col("config")["base_model"].alias("base_model"),
                     F.col("config")["finetuned_model"].alias("finetuned_model"), "r.*")
