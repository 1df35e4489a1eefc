"""Reusable oracle-SQL fragments (DuckDB flavour) mirroring the Spark functions."""

from __future__ import annotations


def tokens(x: str) -> str:
    return f"cast(len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) as bigint)"


def words(x: str) -> str:
    return f"cast(len(regexp_extract_all({x}, '\\S+')) as bigint)"


def word_list(x: str) -> str:
    return f"regexp_extract_all({x}, '\\S+')"


def rouge_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def ratio(t: str, s: str) -> str:
    return f"(case when {s} = 0 then cast('inf' as double) else cast({t} as double) / {s} end)"


def copied(text: str, summary: str) -> str:
    t = strip(f"lower(left({text}, 100))")
    s = strip(f"lower(left({summary}, 100))")
    return f"((({s}) <> '' and starts_with({t}, left({s}, 20))) or starts_with({s}, left({t}, 20)))"


STATS_FEATURES = f"""
select *, {tokens('text')} as text_tokens, {tokens('summary')} as summary_tokens,
       {words('text')} as text_words, {words('summary')} as summary_words
from dataset"""

LENGTH_STATS = f"""
select language, split, count(*) as count,
  avg(text_tokens) as text_tokens_mean, quantile_cont(text_tokens, 0.5) as text_tokens_median,
  stddev_samp(text_tokens) as text_tokens_std, min(text_tokens) as text_tokens_min, max(text_tokens) as text_tokens_max,
  quantile_cont(text_tokens, 0.95) as text_tokens_p95, quantile_cont(text_tokens, 0.99) as text_tokens_p99,
  avg(summary_tokens) as summary_tokens_mean, quantile_cont(summary_tokens, 0.5) as summary_tokens_median,
  stddev_samp(summary_tokens) as summary_tokens_std, min(summary_tokens) as summary_tokens_min,
  max(summary_tokens) as summary_tokens_max,
  quantile_cont(summary_tokens, 0.95) as summary_tokens_p95, quantile_cont(summary_tokens, 0.99) as summary_tokens_p99,
  avg(text_words) as text_words_mean, quantile_cont(text_words, 0.5) as text_words_median,
  min(text_words) as text_words_min, max(text_words) as text_words_max,
  avg(summary_words) as summary_words_mean, quantile_cont(summary_words, 0.5) as summary_words_median,
  min(summary_words) as summary_words_min, max(summary_words) as summary_words_max,
  avg({ratio('text_tokens', 'summary_tokens')}) as compression_tokens_mean,
  quantile_cont({ratio('text_tokens', 'summary_tokens')}, 0.5) as compression_tokens_median,
  avg({ratio('text_words', 'summary_words')}) as compression_words_mean,
  quantile_cont({ratio('text_words', 'summary_words')}, 0.5) as compression_words_median
from ({STATS_FEATURES}) f
group by language, split"""

STATS_DOUBLES = ("text_tokens_mean,text_tokens_median,text_tokens_std,text_tokens_p95,text_tokens_p99,"
                 "summary_tokens_mean,summary_tokens_median,summary_tokens_std,summary_tokens_p95,summary_tokens_p99,"
                 "text_words_mean,text_words_median,summary_words_mean,summary_words_median,"
                 "compression_tokens_mean,compression_tokens_median,compression_words_mean,compression_words_median")

COPY_RATIO = f"""
select language, split, count(*) as n, count(*) filter (where {copied('text', 'summary')}) as copied,
       avg(case when {copied('text', 'summary')} then 1.0 else 0.0 end) as copy_ratio
from dataset group by language, split"""
