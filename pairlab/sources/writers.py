"""Sinks.  Every writer is a distributed Spark write (no per-row files, no
driver-side assembly of data): the one-JSON-per-row layout of the reference
becomes partitioned Parquet/JSON, nested reports become long tables plus a
small JSON header.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_articles(df: DataFrame, root: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One record per (language, id), partitioned by language."""
    df.write.mode(mode).partitionBy("language").format(fmt).save(root)


def index_table(df: DataFrame, id_col: str = "id", language: str = "language", title: str = "title",
                url: str = "url", position: str | None = None) -> DataFrame:
    """Long articles -> one row per id with title and url maps.

    Of rows with the same (id, language) the one with the largest ``position``
    wins (without that column, or at equal positions, the one with the largest
    title and url: never the physical order), so ``map_from_entries`` never sees duplicate keys; entries are sorted
    by language for a deterministic map order.
    """
    order = F.struct(*([position] if position else []), title, url)
    last = df.groupBy(id_col, language).agg(F.max_by(F.struct(title, url), order).alias("_v"))
    g = last.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(language, "_v"))).alias("_e"))
    return g.select(id_col,
                    F.map_from_entries(F.transform("_e", lambda e: F.struct(e[language], e["_v"][title]))).alias("titles"),
                    F.map_from_entries(F.transform("_e", lambda e: F.struct(e[language], e["_v"][url]))).alias("urls"))


def write_index(df: DataFrame, path: str, mode: str = "overwrite", position: str | None = None) -> None:
    index_table(df, position=position).write.mode(mode).json(path)


def write_records(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Whole records as JSON lines in a folder per language (``layout="lines"`` of the readers)."""
    df.write.mode(mode).partitionBy("language").json(root)


def write_summaries(df: DataFrame, root: str, mode: str = "append") -> None:
    """Summary rows by language; appends (idempotency comes from the
    anti-join in ``incremental_generate``)."""
    df.write.mode(mode).partitionBy("language").parquet(root)


def write_split_dataset(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("language", "split").parquet(root)


def run_metadata(df: DataFrame, config: dict, now: str, language: str = "language",
                 split: str | None = "split") -> DataFrame:
    """One-row manifest: totals, languages, rows per language, split ratios, fields,
    config, timestamp.  Rows are counted per language first; null languages count
    in the totals only."""
    sizes = ["n"] + ([f"n_{s}" for s in ("train", "validation", "test")] if split else [])
    per = df.groupBy(F.col(language).alias("l")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(split) == c[2:]).alias(c) for c in sizes[1:]])
    named = F.array_sort(F.collect_list(F.when(F.col("l").isNotNull(), F.struct("l", "n"))))
    m = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias("total_rows" if c == "n" else c) for c in sizes],
                F.array_sort(F.collect_list("l")).alias("languages"), F.map_from_entries(named).alias("article_counts"))
    if split:
        for s in ("train", "validation", "test"):
            m = m.withColumn(f"ratio_{s}", F.try_divide(F.col(f"n_{s}"), F.col("total_rows")))
    return (m.withColumn("fields", F.array(*[F.lit(c) for c in df.columns]))
            .withColumn("config", F.lit(json.dumps(config, sort_keys=True)))
            .withColumn("created_at", F.lit(now)))


def write_run_metadata(df: DataFrame, path: str, config: dict, now: str) -> None:
    run_metadata(df, config, now).coalesce(1).write.mode("overwrite").json(path)


def write_comparison_report(rows: DataFrame, path: str, config: dict, averages: DataFrame | None = None) -> None:
    """Comparison rows as a long Parquet table plus a small JSON header with
    the config and the per-model averages (bounded: one row per model)."""
    rows.write.mode("overwrite").parquet(os.path.join(path, "comparisons"))
    cfg = F.lit(json.dumps(config, sort_keys=True)).alias("config")
    if averages is not None:
        header = averages.agg(F.to_json(F.collect_list(F.struct(*averages.columns))).alias("average_metrics"))
        header = header.select(cfg, "average_metrics")
    else:
        header = rows.sparkSession.range(1).select(cfg)
    header.coalesce(1).write.mode("overwrite").json(os.path.join(path, "header"))


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line in every part file (readers take the folder)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def stats_json(df: DataFrame, keys: Sequence[str], groups: dict[str, Sequence[str]]) -> DataFrame:
    """keys + one JSON column nesting ``{field: {stat: value}}``."""
    nested = [F.struct(*[F.col(c).alias(c.split("__", 1)[-1]) for c in cols]).alias(name)
              for name, cols in groups.items()]
    return df.select(*keys, F.to_json(F.struct(*nested)).alias("stats"))


def write_stats_json(df: DataFrame, path: str, keys: Sequence[str], groups: dict[str, Sequence[str]]) -> None:
    stats_json(df, keys, groups).write.mode("overwrite").json(path)


def _rename(fs, src, dst) -> bool:
    return fs.rename(src, dst)


def rewrite_or_copy(df: DataFrame, src: str, dst: str | None = None, fmt: str = "parquet",
                    partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` to ``dst``; without ``dst`` replace ``src`` in place.

    Spark cannot overwrite a path it is reading, so the in-place case writes
    a staging copy next to ``src`` and swaps directories with the Hadoop
    file system API (a rename on the shared file system).
    """
    if dst:
        df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(dst)
        return dst
    spark: SparkSession = df.sparkSession
    staging = src.rstrip("/") + "._staging"
    df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(staging)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    sp, tp = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(staging)
    fs = sp.getFileSystem(conf)
    old = jvm.org.apache.hadoop.fs.Path(src.rstrip("/") + "._old")
    if fs.exists(old):
        fs.delete(old, True)
    if not _rename(fs, sp, old):
        raise OSError(f"could not move {src} aside; the new data is in {staging}")
    if not _rename(fs, tp, sp):
        if not _rename(fs, old, sp):
            raise OSError(f"could not move {staging} to {src}; the old data is in {old}")
        raise OSError(f"could not move {staging} to {src}; the old data is back in place")
    fs.delete(old, True)  # only once the new data is in place
    return src
