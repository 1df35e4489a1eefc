"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.session import scratch_path


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table of its own: a checkpoint would keep the size estimates, whose digits multiply in a loop of joins."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links -> ``(node, component)``, the component being its least node.

    Every round takes the least label among the neighbours, then the label of
    that label, so the rounds grow with the logarithm of the diameter.  Labels
    are written to the shared checkpoint folder each round, the last round's are
    deleted; only whether any label moved reaches the driver.  A node with very
    many links is pre-aggregated before the shuffle by node and split by the skew
    handling of the join with the labels.
    """
    spark = edges.sparkSession
    folder = scratch_path(spark, f"components-{uuid.uuid4().hex}")
    both = _written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{folder}/links")
    labels = _written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                      .select("node", F.least("node", "m").alias("component"), F.lit(True).alias("moved")), f"{folder}/0")
    turn = 0
    while True:
        seen = labels.select(F.col("node").alias("b"), "component")
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        stepped = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("up"))
        roots = labels.select(F.col("node").alias("up"), F.col("component").alias("root"))
        jumped = stepped.join(roots, "up").select("node", F.least("up", "root").alias("component"), "old")
        turn += 1
        labels = _written(jumped.select("node", "component", (F.col("component") != F.col("old")).alias("moved")), f"{folder}/{turn}")
        delete_path(spark, f"{folder}/{turn - 1}")
        if labels.filter("moved").isEmpty():
            return labels.select("node", "component")
