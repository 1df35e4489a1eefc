"""Corpus profiling: length statistics, percentiles, histograms, content checks.

One scan computes every per-row feature (JVM expressions), one
``groupBy(language, split)`` computes every statistic: the exchange carries
partial aggregation buffers, not rows.  Exact percentiles keep a
value->count map per group (lengths are integers, so the map is bounded by
the longest text); ``approx=True`` switches to ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions import text as T

PCTS = (0.5, 0.95, 0.99)
POINT_BITS = 8  # 255 split points for each group and column


def length_features(df: DataFrame, text: str = "text", summary: str = "summary",
                    tokenizer: str = "wordpunct") -> DataFrame:
    """Per-row token/word/char/sentence counts and compression ratios."""
    return (df.withColumn("text_tokens", T.token_len(text, tokenizer))
            .withColumn("summary_tokens", T.token_len(summary, tokenizer))
            .withColumn("text_words", T.word_len(text))
            .withColumn("summary_words", T.word_len(summary))
            .withColumn("text_chars", T.char_len(text))
            .withColumn("summary_chars", T.char_len(summary))
            .withColumn("text_sentences", T.sentence_count(text))
            .withColumn("summary_sentences", T.sentence_count(summary))
            .withColumn("token_compression_ratio", T.compression_ratio("text_tokens", "summary_tokens"))
            .withColumn("word_compression_ratio", T.compression_ratio("text_words", "summary_words")))


def _pct(x: str, qs: Sequence[float], approx: bool) -> Column:
    if approx:
        return F.percentile_approx(F.col(x).cast("double"), list(qs), 10000)
    return F.percentile(F.col(x), F.array(*[F.lit(q) for q in qs]))


def exact_quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], qs: Sequence[float],
                    points: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles by histogram selection.

    ``percentile`` keeps one map entry per distinct value and group, which
    does not bound memory for doubles (~one distinct value per row).  Here:

    1. the columns are stacked into (group, column, value) rows and counted
       per range bucket -- a partial aggregate;
    2. running counts over the small (group, bucket) table locate the
       buckets that hold the wanted ranks;
    3. only rows of those buckets are aggregated by value (ties collapse in
       the partial aggregate, so a value shared by a third of the rows is one
       row) and running counts over their distinct values give the exact
       order statistics, interpolated as numpy / pandas do.

    ``points`` gives the range buckets' split points where they are known: a table
    (by, ``_c``, ``points``) of one row per group and column, bounded in length.  Otherwise
    they are a scalar subquery over the values.

    Output: by + ``{col}_p{q}`` (null for an empty group).
    """
    from pairlab.operators.ranking import balanced_bucket, null_safe_join, split_bucket, with_bucket
    by = list(by)
    g = by + ["_c"]
    stacked = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in cols])).alias("_s"))
    v = stacked.select(*by, F.col("_s.c").alias("_c"), F.col("_s.x").alias("_x")).filter(F.col("_x").isNotNull())
    finite = v.filter(~F.isnan("_x") & (F.abs("_x") != float("inf")))
    if points is not None:
        v = null_safe_join(v, points.select(*g, "points"), g, "left")
        v = v.withColumn("_near", split_bucket(F.col("_x"), F.coalesce("points", F.array().cast("array<double>")), POINT_BITS)).drop("points")
    else:
        v = with_bucket(v, balanced_bucket(finite, "_x"), "_near")
    v = v.withColumn("_b", F.when(F.col("_x") == float("-inf"), F.lit(-1))
                     .when(F.isnan("_x") | (F.col("_x") == float("inf")), F.lit(1 << 40))
                     .otherwise(F.col("_near"))).drop("_near")
    hist = v.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    wb = Window.partitionBy(*g).orderBy("_b")
    hist = (hist.withColumn("_before", F.coalesce(F.sum("_nb").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                                                  F.lit(0)))
            .withColumn("_n", F.sum("_nb").over(Window.partitionBy(*g))))
    # the 1-based ranks each quantile needs (lower and upper neighbour)
    ranks = []
    for i, q in enumerate(qs):
        h = (F.col("_n") - 1) * F.lit(q)
        ranks += [F.struct(F.lit(i).alias("qi"), F.lit("lo").alias("side"), (F.floor(h) + 1).alias("rank"),
                           h.alias("h")),
                  F.struct(F.lit(i).alias("qi"), F.lit("hi").alias("side"), (F.ceil(h) + 1).alias("rank"),
                           h.alias("h"))]
    need = (hist.select(*g, "_b", "_before", "_nb", F.explode(F.array(*ranks)).alias("_k"))
            .filter((F.col("_k.rank") > F.col("_before")) & (F.col("_k.rank") <= F.col("_before") + F.col("_nb")))
            .select(*g, "_b", "_before", F.col("_k.qi").alias("qi"), F.col("_k.side").alias("side"),
                    F.col("_k.rank").alias("rank"), F.col("_k.h").alias("h")))
    target_buckets = need.select(*g, "_b").distinct()
    counts = (null_safe_join(v, target_buckets, g + ["_b"])
              .groupBy(*g, "_b", "_x").agg(F.count(F.lit(1)).alias("_m")))
    wv = Window.partitionBy(*g, "_b").orderBy("_x")
    counts = counts.withColumn("_upto", F.sum("_m").over(wv.rowsBetween(Window.unboundedPreceding, 0)))
    # value at a rank: smallest distinct value whose running count reaches it
    picked = (null_safe_join(need, counts, g + ["_b"])
              .filter(F.col("_before") + F.col("_upto") >= F.col("rank"))
              .groupBy(*g, "qi", "side", "h").agg(F.min("_x").alias("val")))
    per_q = (picked.groupBy(*g, "qi", "h")
             .agg(F.max(F.when(F.col("side") == "lo", F.col("val"))).alias("lo"),
                  F.max(F.when(F.col("side") == "hi", F.col("val"))).alias("hi")))
    frac = F.col("h") - F.floor("h")
    per_q = per_q.withColumn("val", F.when(frac == 0, F.col("lo"))
                             .otherwise((F.lit(1.0) - frac) * F.col("lo") + frac * F.col("hi")))
    names = [f"p{int(round(q * 100))}" for q in qs]
    return per_q.groupBy(*by).agg(*[F.max(F.when((F.col("_c") == c) & (F.col("qi") == i), F.col("val")))
                                    .alias(f"{c}_{n}") for c in cols for i, n in enumerate(names)])


def length_stats(df: DataFrame, by: Sequence[str] = ("language", "split"), text: str = "text",
                 summary: str = "summary", tokenizer: str = "wordpunct",
                 approx: bool = False, with_copy_ratio: bool = False, more_percentiles: Sequence[float] = ()) -> DataFrame:
    """Per group: token mean/median/std/min/max/p95/p99 (text, summary), word
    mean/median/min/max, compression mean/median (tokens, words), count
    (and ``more_percentiles`` of the token lengths and the copied-lead ratio in
    the same aggregation when asked)."""
    f = length_features(df, text, summary, tokenizer)
    if with_copy_ratio:
        f = f.withColumn("_copied", T.copied_lead_flag(text, summary).cast("double"))
    if not approx:
        # the exact ratio medians take more passes over the features: compute
        # the per-row numbers once (texts dropped) and checkpoint them reliably
        from pairlab.session import cut_lineage
        f = cut_lineage(f.select(*by, *feature_columns(f)))
    return stats_of_features(f, by, approx, with_copy_ratio, more_percentiles)


def feature_columns(f: DataFrame) -> list[str]:
    return [c for c in f.columns if c.endswith(("_tokens", "_words", "_ratio")) or c == "_copied"]


RATIOS = ("token_compression_ratio", "word_compression_ratio")


def stats_of_features(f: DataFrame, by: Sequence[str] = ("language", "split"), approx: bool = False, with_copy_ratio: bool = False,
                      more_percentiles: Sequence[float] = (), points: DataFrame | None = None) -> DataFrame:
    """``length_stats`` of rows whose features are there already; ``points`` as in ``exact_quantiles``."""
    pcts = [*PCTS, *more_percentiles]
    aggs = [F.count(F.lit(1)).alias("count")]
    if with_copy_ratio:
        aggs.append(F.avg("_copied").alias("copy_ratio"))
    for c in ("text_tokens", "summary_tokens"):
        aggs += [F.avg(c).alias(f"{c}_mean"), _pct(c, pcts, approx).alias(f"_{c}_p"),
                 F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"),
                 F.max(c).alias(f"{c}_max")]
    for c in ("text_words", "summary_words"):
        aggs += [F.avg(c).alias(f"{c}_mean"), _pct(c, [0.5], approx).alias(f"_{c}_p"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    for c, n in (("token_compression_ratio", "tokens"), ("word_compression_ratio", "words")):
        aggs.append(F.avg(c).alias(f"compression_{n}_mean"))
        if approx:
            aggs.append(_pct(c, [0.5], approx).alias(f"_cmp_{n}_p"))
    g = f.groupBy(*by).agg(*aggs)
    if not approx:
        # ratios are doubles with about one distinct value per row: their exact
        # medians come from a rank, not from a per-group value map
        med = exact_quantiles(f, by, RATIOS, [0.5], points)
        med = med.select(*by, F.array("token_compression_ratio_p50").alias("_cmp_tokens_p"),
                         F.array("word_compression_ratio_p50").alias("_cmp_words_p"))
        from pairlab.operators.ranking import null_safe_join
        g = null_safe_join(g, med, list(by), "left")
    out = [*by, "count"]
    for c in ("text_tokens", "summary_tokens"):
        out += [f"{c}_mean", F.col(f"_{c}_p")[0].cast("double").alias(f"{c}_median"), f"{c}_std",
                f"{c}_min", f"{c}_max", F.col(f"_{c}_p")[1].cast("double").alias(f"{c}_p95"),
                F.col(f"_{c}_p")[2].cast("double").alias(f"{c}_p99")]
        out += [F.col(f"_{c}_p")[i].cast("double").alias(f"{c}_p{int(round(q * 100))}")
                for i, q in enumerate(pcts) if i >= len(PCTS)]
    for c in ("text_words", "summary_words"):
        out += [f"{c}_mean", F.col(f"_{c}_p")[0].cast("double").alias(f"{c}_median"),
                f"{c}_min", f"{c}_max"]
    for n in ("tokens", "words"):
        out += [f"compression_{n}_mean", F.col(f"_cmp_{n}_p")[0].cast("double").alias(f"compression_{n}_median")]
    if with_copy_ratio:
        out.append("copy_ratio")
    return g.select(*out)


def _integral(df: DataFrame, col: str) -> bool:
    from pyspark.sql import types as TT
    return isinstance(df.schema[col].dataType, (TT.IntegerType, TT.LongType, TT.ShortType, TT.ByteType))


def length_percentiles(df: DataFrame, col: str, by: Sequence[str] = ("language", "split"),
                       qs: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.97, 0.99),
                       approx: bool = False) -> DataFrame:
    """Percentiles of ``col`` per group (linear interpolation).

    Integer lengths use ``percentile`` (its value map is bounded by the
    longest text); other columns use ``exact_quantiles`` (no value map).
    """
    names = [f"p{int(round(q * 100))}" for q in qs]
    if not approx and not _integral(df, col):
        e = exact_quantiles(df, by, [col], qs)
        return e.select(*by, *[F.col(f"{col}_{n}").alias(n) for n in names])
    g = df.groupBy(*by).agg(_pct(col, qs, approx).alias("_p"))
    return g.select(*by, *[F.col("_p")[i].cast("double").alias(n) for i, n in enumerate(names)])


def copied_lead_ratio(df: DataFrame, by: Sequence[str] = ("language", "split"),
                      text: str = "text", summary: str = "summary", sample_n: int | None = None,
                      seed: int = 0, key: str = "article_id") -> DataFrame:
    """Share of rows whose summary looks like the article's lead.

    Over the full data by default; ``sample_n`` keeps a seeded sample of that
    many rows per group first (the reference's sample of at most 100), as a
    per-group top-n that is cut before the shuffle.
    """
    if sample_n is not None:
        from pairlab.operators.ranking import seeded_key
        w = Window.partitionBy(*by).orderBy(seeded_key(key, seed), F.col(key))
        df = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample_n).drop("_r")
    flag = T.copied_lead_flag(text, summary)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               F.count_if(flag).alias("copied"),
                               F.avg(flag.cast("double")).alias("copy_ratio"))


def cross_language_table(stats: DataFrame, copy: DataFrame | None = None,
                         split: str = "train") -> DataFrame:
    """Train-split row per language: mean/median/max tokens, median compression,
    copy ratio."""
    s = stats.filter(F.col("split") == split).select(
        "language", "text_tokens_mean", "text_tokens_median", "text_tokens_max",
        "summary_tokens_mean", "summary_tokens_median", "summary_tokens_max",
        F.col("compression_tokens_median"))
    if copy is not None:
        s = s.join(copy.filter(F.col("split") == split).select("language", "copy_ratio"), "language", "left")
    return s


# Fixed values of the length recommendation rule: head-room factor, clamps
# and rounding multiples for input and target lengths.
HEADROOM = 1.1
INPUT_CLAMP = (1024, 4096)
INPUT_MULTIPLE = 128
TARGET_CLAMP = (128, 1024)
TARGET_MULTIPLE = 32


def _recommend(p95: Column, lo: int, hi: int, mult: int) -> Column:
    raw = (p95 * F.lit(HEADROOM)).cast("bigint")  # int() truncation
    clamped = F.least(F.greatest(raw, F.lit(lo)), F.lit(hi))
    return (F.ceil(clamped / F.lit(mult)) * F.lit(mult)).cast("bigint")


def recommended_lengths(stats: DataFrame, split: str = "train") -> DataFrame:
    """max over languages of train p95 x 1.1, clamped and rounded up."""
    s = stats.filter(F.col("split") == split).agg(
        F.max("text_tokens_p95").alias("max_text_p95"), F.max("summary_tokens_p95").alias("max_summary_p95"))
    return _with_recommended(s)


def _with_recommended(s: DataFrame) -> DataFrame:
    return (s.withColumn("max_input_length", _recommend(F.col("max_text_p95"), *INPUT_CLAMP, INPUT_MULTIPLE))
            .withColumn("max_target_length", _recommend(F.col("max_summary_p95"), *TARGET_CLAMP, TARGET_MULTIPLE))
            .withColumn("total_length", F.col("max_input_length") + F.col("max_target_length")))


def with_recommended_lengths(stats: DataFrame, split: str = "train") -> DataFrame:
    """The statistics (a row per language and split) with ``recommended_lengths`` on each row."""
    every = Window.partitionBy()
    train = lambda c: F.max(F.when(F.col("split") == split, F.col(c))).over(every)
    return _with_recommended(stats.withColumn("max_text_p95", train("text_tokens_p95"))
                             .withColumn("max_summary_p95", train("summary_tokens_p95"))).drop("max_text_p95", "max_summary_p95")


def corpus_warning(stats: DataFrame, copy: DataFrame, split: str = "train",
                   threshold: float = 0.2) -> DataFrame:
    """Mean over languages of median compression and of copy ratio; warn above threshold."""
    s = stats.filter(F.col("split") == split).select("language", "compression_tokens_median")
    c = copy.filter(F.col("split") == split).select("language", "copy_ratio")
    j = s.join(c, "language", "left")
    return (j.agg(F.avg("compression_tokens_median").alias("avg_compression"),
                  F.avg("copy_ratio").alias("avg_copy_ratio"))
            .withColumn("warning", F.col("avg_copy_ratio") > F.lit(threshold)))


def start_word_counts(df: DataFrame, k: int = 10, by: Sequence[str] = (),
                      summary: str = "summary") -> DataFrame:
    """Top ``k`` lower-cased first words of summaries (ties by word)."""
    w = df.select(*by, T.first_word_lower(summary).alias("word")).filter(F.col("word").isNotNull())
    counts = w.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), "word").limit(k)
    win = Window.partitionBy(*by).orderBy(F.desc("n"), "word")
    return counts.withColumn("_r", F.row_number().over(win)).filter(F.col("_r") <= k).drop("_r")


def length_histogram(df: DataFrame, col: str, bins: int = 30, clip_q: float | None = 0.99,
                     by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram; values clipped at the ``clip_q`` quantile first.

    Bounds come from one aggregate per group (joined back, small); bins are a
    pure expression, counts one more partial aggregate.
    """
    from pairlab.operators.ranking import null_safe_join
    by = list(by)
    x = F.col(col).cast("double")
    if clip_q is not None and not _integral(df, col):
        # a double column: exact clip quantile without a per-group value map
        q = exact_quantiles(df, by, [col], [clip_q])
        hi = q.select(*by, F.col(f"{col}_p{int(round(clip_q * 100))}").alias("_hi"))
        lo = df.groupBy(*by).agg(F.min(x).alias("_lo"))
        bounds = null_safe_join(lo, hi, by) if by else lo.withColumn("_hi", hi.scalar())
    else:
        bounds = df.groupBy(*by).agg(
            F.min(x).alias("_lo"),
            (F.percentile(x, F.lit(clip_q)) if clip_q is not None else F.max(x)).alias("_hi"))
    if by:
        j = null_safe_join(df, bounds, by)
    else:  # one row of bounds: scalar subqueries, no join
        j = df.withColumn("_lo", bounds.select("_lo").scalar()).withColumn("_hi", bounds.select("_hi").scalar())
    v = F.least(x, F.col("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.when(width <= 0, F.lit(0)).otherwise(
        F.least(F.floor((v - F.col("_lo")) / width), F.lit(bins - 1))).cast("bigint")
    h = j.withColumn("bin", b).groupBy(*by, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    return h.select(*by, "bin",
                    (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / F.lit(bins)).alias("bin_start"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / F.lit(bins)).alias("bin_end"),
                    "n")


def length_scatter_sample(df: DataFrame, x: str, y: str, n: int, seed: int, key: str) -> DataFrame:
    """(x, y) points of a deterministic seeded sample of ``n`` rows."""
    from pairlab.operators.corpus import seeded_sample
    return seeded_sample(df.select(key, x, y), n, seed, key)


def summary_length_metrics(df: DataFrame, by: Sequence[str] = ("model",), generated: str = "generated",
                           reference: str = "reference") -> DataFrame:
    """avg/median generated and reference word counts, ratio of means, Pearson r.

    ``corr`` is guarded: zero variance (or < 2 rows) gives null instead of
    raising under ANSI mode.
    """
    g = F.col("_g").cast("double")
    r = F.col("_r").cast("double")
    f = df.select(*by, T.word_len(generated).alias("_g"), T.word_len(reference).alias("_r"))
    a = f.groupBy(*by).agg(
        F.avg("_g").alias("avg_generated_words"), F.avg("_r").alias("avg_reference_words"),
        F.median("_g").cast("double").alias("median_generated_words"),
        F.median("_r").cast("double").alias("median_reference_words"),
        F.var_pop(g).alias("_vg"), F.var_pop(r).alias("_vr"),
        F.covar_pop(g, r).alias("_cov"), F.count(F.lit(1)).alias("_n"))
    return a.select(*by, "avg_generated_words", "avg_reference_words", "median_generated_words",
                    "median_reference_words",
                    F.try_divide(F.col("avg_generated_words"), F.col("avg_reference_words")).alias("length_ratio"),
                    F.when((F.col("_vg") > 0) & (F.col("_vr") > 0) & (F.col("_n") > 1),
                           F.col("_cov") / F.sqrt(F.col("_vg") * F.col("_vr"))).alias("length_correlation"))


def gen_len(df: DataFrame, by: Sequence[str] = ("model",), generated: str = "generated") -> DataFrame:
    """Mean word count of generations."""
    return df.groupBy(*by).agg(F.avg(T.word_len(generated)).alias("gen_len"))
