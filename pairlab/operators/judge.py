"""Judge result tables: parse, improvement, statistics, parse audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions import judge as J


def parse_judge_scores(df: DataFrame, response: str = "response", base_is_a: bool = True) -> DataFrame:
    """Add base_score, finetuned_score, explanation, parse_path, improvement, in_range.

    The judge sees the base summary as A and the tuned one as B.
    """
    p = df.withColumn("_p", J.parse_judge_scores(response))
    a, b = ("score_a", "score_b") if base_is_a else ("score_b", "score_a")
    return (p.withColumn("base_score", F.col(f"_p.{a}"))
            .withColumn("finetuned_score", F.col(f"_p.{b}"))
            .withColumn("explanation", F.col("_p.explanation"))
            .withColumn("parse_path", F.col("_p.path"))
            .withColumn("improvement", J.judge_improvement("base_score", "finetuned_score"))
            .withColumn("in_range", J.in_range("base_score") & J.in_range("finetuned_score"))
            .drop("_p"))


def judge_statistics(results: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Per run over rows with both scores: means, win/tie/loss rates, counts.

    One partial aggregation; a run without any valid row gets the error
    message instead of statistics.
    """
    valid = F.col("base_score").isNotNull() & F.col("finetuned_score").isNotNull()
    b = F.when(valid, F.col("base_score"))
    t = F.when(valid, F.col("finetuned_score"))
    nv = F.count_if(valid)
    g = results.groupBy(*by).agg(
        F.avg(b).alias("average_base_score"), F.avg(t).alias("average_finetuned_score"),
        F.avg(t - b).alias("average_improvement"),
        F.count_if(valid & (F.col("finetuned_score") > F.col("base_score"))).alias("_w"),
        F.count_if(valid & (F.col("finetuned_score") == F.col("base_score"))).alias("_t"),
        F.count_if(valid & (F.col("finetuned_score") < F.col("base_score"))).alias("_l"),
        nv.alias("valid_evaluations"), F.count(F.lit(1)).alias("total_evaluations"))
    n = F.col("valid_evaluations")
    return g.select(*by, "average_base_score", "average_finetuned_score", "average_improvement",
                    F.try_divide(F.col("_w"), n).alias("win_rate"), F.try_divide(F.col("_t"), n).alias("tie_rate"),
                    F.try_divide(F.col("_l"), n).alias("loss_rate"), "valid_evaluations", "total_evaluations",
                    F.when(n == 0, F.lit("No valid evaluation results")).alias("error"))


def judge_parse_audit(results: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """How often each fallback path produced the scores."""
    return results.groupBy(*by, "parse_path").agg(F.count(F.lit(1)).alias("n"))
