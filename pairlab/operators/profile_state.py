"""Corpus profiles that grow with their files: mergeable states per run of new files.

A state folder holds, for each run that added files,

* ``files``: what was read (path, length, modification time); written last, so that an
  interrupted run counts for nothing and is written over by the next,
* ``features``: the per-row numbers of those files (no texts),
* ``sketches``: a KLL sketch for each (group, column) of doubles.

A later run reads only files it doesn't know.  Sketches of all runs merge into
split points for the exact quantiles, which are selected from the features; the
merged points are written, as a merge isn't the same bit by bit each time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.functions import text as T
from pairlab.operators import profile as PR

FILES = "path string, length bigint, modified timestamp"


@dataclass(frozen=True)
class ProfileState:
    spark: SparkSession
    folder: str
    by: tuple[str, ...] = ("language", "split")
    tokenizer: str = "wordpunct"

    def _path(self, kind: str, run: int) -> str:
        return f"{self.folder}/{kind}/run{run}"

    def runs(self) -> int:
        """Runs that ended: their list of files is whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        n = 0
        while True:
            mark = path(f"{self._path('files', n)}/_SUCCESS")
            if not mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark):
                return n
            n += 1

    def _all(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(*(self._path(kind, k) for k in range(self.runs())))

    def new_files(self, root: str) -> DataFrame:
        """Files under ``root`` that no run has read, or that have changed since."""
        listed = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
                  .select("path", "length", F.col("modificationTime").alias("modified")))
        if not self.runs():
            return listed
        return listed.join(self._all("files"), ["path", "length", "modified"], "left_anti")

    def add(self, root: str, schema: str, text: str = "text", summary: str = "summary") -> int:
        """Reads the new files of a dataset under ``root``; returns how many."""
        run, files = self.runs(), self.new_files(root).collect()  # a file listing, as Spark's own scan makes it
        if not files:
            return 0
        rows = self.spark.read.schema(schema).option("basePath", root).parquet(*(r["path"] for r in files))
        f = PR.length_features(rows, text, summary, self.tokenizer).withColumn("_copied", T.copied_lead_flag(text, summary).cast("double"))
        f.select(*self.by, *PR.feature_columns(f)).write.mode("overwrite").parquet(self._path("features", run))
        features = self.spark.read.parquet(self._path("features", run))
        stacked = features.select(*self.by, F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in PR.RATIOS))).alias("s"))
        stacked = stacked.select(*self.by, F.col("s.c").alias("_c"), F.col("s.x").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
        (stacked.groupBy(*self.by, "_c").agg(F.kll_sketch_agg_double("x").alias("sketch"))
         .write.mode("overwrite").parquet(self._path("sketches", run)))
        self.spark.createDataFrame(files, FILES).write.mode("overwrite").parquet(self._path("files", run))
        return len(files)

    def _points(self) -> DataFrame:
        """Split points of all runs' sketches, merged once for each state."""
        runs, n = self.runs(), 1 << PR.POINT_BITS
        path = self._path("points", runs)
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark):
            merged = self._all("sketches").groupBy(*self.by, "_c").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
            ranks = F.array(*(F.lit(i / n) for i in range(1, n)))
            points = F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_double("sketch", ranks)))
            merged.select(*self.by, "_c", points.alias("points")).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def profile(self, more_percentiles: Sequence[float] = (0.75, 0.9, 0.97)) -> DataFrame:
        """The profile of all files read so far, as ``profile_corpus`` gives it."""
        stats = PR.stats_of_features(self._all("features"), self.by, with_copy_ratio=True, more_percentiles=more_percentiles, points=self._points())
        return PR.with_recommended_lengths(stats)
