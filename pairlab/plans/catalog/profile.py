"""Corpus profile queries over the split pair dataset."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pairlab.functions import text as T
from pairlab.operators import corpus as C
from pairlab.operators import profile as PR
from pairlab.operators.profile_state import ProfileState
from pairlab.plans import fixtures as FX
from pairlab.plans.catalog import sqlbits as Q
from pairlab.plans.catalog.base import register, rsql
from pairlab.plans.catalog.io import _fresh


@register("length_stats", rsql(Q.LENGTH_STATS, Q.STATS_DOUBLES, ("dataset",)))
def length_stats(t):
    return PR.length_stats(FX.dataset(t))


@register("length_percentiles", rsql(f"""
select language, split,
  quantile_cont(x, 0.5) as p50, quantile_cont(x, 0.75) as p75, quantile_cont(x, 0.9) as p90,
  quantile_cont(x, 0.95) as p95, quantile_cont(x, 0.97) as p97, quantile_cont(x, 0.99) as p99
from (select language, split, {Q.tokens('text')} as x from dataset) f group by language, split""",
        "p50,p75,p90,p95,p97,p99", ("dataset",)))
def length_percentiles(t):
    d = FX.dataset(t).withColumn("x", T.token_len("text"))
    return PR.length_percentiles(d, "x")


@register("copied_lead_ratio", rsql(Q.COPY_RATIO, "copy_ratio", ("dataset",)))
def copied_lead_ratio(t):
    return PR.copied_lead_ratio(FX.dataset(t))


@register("cross_language_table", rsql(f"""
select s.language, s.text_tokens_mean, s.text_tokens_median, s.text_tokens_max, s.summary_tokens_mean,
       s.summary_tokens_median, s.summary_tokens_max, s.compression_tokens_median, c.copy_ratio
from ({Q.LENGTH_STATS}) s left join ({Q.COPY_RATIO}) c on s.language = c.language and s.split = c.split
where s.split = 'train'""", "text_tokens_mean,text_tokens_median,summary_tokens_mean,summary_tokens_median,"
        "compression_tokens_median,copy_ratio", ("dataset",)))
def cross_language_table(t):
    d = FX.dataset(t)
    return PR.cross_language_table(PR.length_stats(d), PR.copied_lead_ratio(d))


def _recommend_sql(x: str, lo: int, hi: int, mult: int) -> str:
    return f"cast(ceil(least(greatest(cast(trunc({x} * 1.1) as bigint), {lo}), {hi}) / {mult}) * {mult} as bigint)"


_RECOMMENDED = f"""
select max_text_p95, max_summary_p95,
       {_recommend_sql('max_text_p95', 1024, 4096, 128)} as max_input_length,
       {_recommend_sql('max_summary_p95', 128, 1024, 32)} as max_target_length,
       {_recommend_sql('max_text_p95', 1024, 4096, 128)} + {_recommend_sql('max_summary_p95', 128, 1024, 32)}
         as total_length
from (select max(text_tokens_p95) as max_text_p95, max(summary_tokens_p95) as max_summary_p95
      from ({Q.LENGTH_STATS}) s where split = 'train') m"""

# percentiles of the profile beside those of the length statistics
_MORE = [(c, q, n) for c in ("text_tokens", "summary_tokens") for q, n in (("75", "p75"), ("9", "p90"), ("97", "p97"))]


@register("recommended_lengths", rsql(_RECOMMENDED, "max_text_p95,max_summary_p95", ("dataset",)))
def recommended_lengths(t):
    return PR.recommended_lengths(PR.length_stats(FX.dataset(t)))


@register("corpus_warning", rsql(f"""
select avg(s.compression_tokens_median) as avg_compression, avg(c.copy_ratio) as avg_copy_ratio,
       avg(c.copy_ratio) > 0.2 as warning
from ({Q.LENGTH_STATS}) s left join ({Q.COPY_RATIO}) c on s.language = c.language and s.split = c.split
where s.split = 'train'""", "avg_compression,avg_copy_ratio", ("dataset",)))
def corpus_warning(t):
    d = FX.dataset(t)
    return PR.corpus_warning(PR.length_stats(d), PR.copied_lead_ratio(d))


@register("split_counts", rsql("""
select language, count(*) filter (where split = 'train') as train,
       count(*) filter (where split = 'validation') as validation,
       count(*) filter (where split = 'test') as test, count(*) as total
from dataset group by language""", "", ("dataset",)))
def split_counts(t):
    return C.split_counts(FX.dataset(t))


@register("start_word_counts", rsql(f"""
select word, count(*) as n
from (select lower({Q.word_list('summary')}[1]) as word from dataset) w
where word is not null group by word order by n desc, word limit 10""", "", ("dataset",)))
def start_word_counts(t):
    return PR.start_word_counts(FX.dataset(t), k=10)


@register("length_histogram", rsql(f"""
select language, bin, lo + bin * (hi - lo) / 30 as bin_start, lo + (bin + 1) * (hi - lo) / 30 as bin_end,
       count(*) as n
from (select language, lo, hi,
             cast(case when (hi - lo) / 30 <= 0 then 0
                       else least(floor((least(x, hi) - lo) / ((hi - lo) / 30)), 29) end as bigint) as bin
      from (select language, cast({Q.tokens('text')} as double) as x from dataset) v
      join (select language, min(cast({Q.tokens('text')} as double)) as lo,
                   quantile_cont(cast({Q.tokens('text')} as double), 0.99) as hi
            from dataset group by language) b using (language)) h
group by language, bin, lo, hi""", "bin_start,bin_end", ("dataset",)))
def length_histogram(t):
    d = FX.dataset(t).withColumn("x", T.token_len("text"))
    return PR.length_histogram(d, "x", bins=30, clip_q=0.99, by=["language"])


@register("length_scatter_sample", rsql(f"""
select article_id, {Q.tokens('text')} as text_tokens, {Q.tokens('summary')} as summary_tokens
from dataset order by md5(concat('7:', article_id)), article_id limit 100""", "", ("dataset",)))
def length_scatter_sample(t):
    d = FX.dataset(t).select("article_id", T.token_len("text").alias("text_tokens"),
                             T.token_len("summary").alias("summary_tokens"))
    return PR.length_scatter_sample(d, "text_tokens", "summary_tokens", 100, 7, "article_id")


_PROFILE = rsql(f"""
select s.*, p.* exclude (language, split), c.copy_ratio, r.max_input_length, r.max_target_length, r.total_length
from ({Q.LENGTH_STATS}) s join ({Q.COPY_RATIO}) c on s.language = c.language and s.split = c.split
join (select language, split, {', '.join(f"quantile_cont({c}, 0.{q}) as {c}_{n}" for c, q, n in _MORE)}
      from ({Q.STATS_FEATURES}) f group by language, split) p on s.language = p.language and s.split = p.split
cross join ({_RECOMMENDED}) r""",
        ",".join([Q.STATS_DOUBLES, "copy_ratio", *(f"{c}_{n}" for c, _, n in _MORE)]), ("dataset",))


@register("profile_corpus", _PROFILE)
def profile_corpus(t):
    from pairlab.plans.flagships import profile_corpus as pc
    return pc(FX.dataset(t))


@register("profile_corpus_incremental", _PROFILE)
def profile_corpus_incremental(t):
    """The dataset arrives as files in two parts; each run reads the new files and merges its state."""
    base = _fresh(t, "profile_state")
    root, state = os.path.join(base, "data"), ProfileState(t.spark, os.path.join(base, "state"))
    rows = FX.dataset(t).select("language", "split", "text", "summary")
    for part in (F.col("split") == "train", F.col("split") != "train"):
        rows.filter(part).write.mode("append").parquet(root)
        state.add(root, "language string, split string, text string, summary string")
    return state.profile()
