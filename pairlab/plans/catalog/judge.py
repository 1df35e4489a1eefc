"""Judge queries: parsing, statistics, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import judge as J
from pairlab.functions import prompts as P
from pairlab.operators import judge as JO
from pairlab.plans import fixtures as FX
from pairlab.plans.catalog.base import register, rsql

_HAS_AB = "(json_extract(x, '$.score_a') is not null and json_extract(x, '$.score_b') is not null)"
_HAS_SAB = ("(json_extract(x, '$.summary_a_score') is not null and "
            "json_extract(x, '$.summary_b_score') is not null)")
_F_AB = _HAS_AB.replace("x,", "first,")

PARSED_SQL = f"""
with m as (
  select doc_id, language, response,
         regexp_extract_all(response, '{J.JSON_AB}') as ab,
         regexp_extract_all(response, '{J.JSON_SUMMARY_AB}') as sab,
         regexp_extract_all(response, '[0-9]+') as nums
  from judge_responses),
g as (
  select *, list_filter(case when len(ab) > 0 then ab else sab end,
                        lambda x: case when json_valid(x) then ({_HAS_AB} or {_HAS_SAB}) else false end)[1] as first,
         list_filter(nums, lambda x: try_cast(x as double) between 1 and 5) as small,
         regexp_matches(response, '{J.TEXT_AB}') as t_ok
  from m),
s as (
  select doc_id, language, response,
    case when first is not null then try_cast(case when {_F_AB} then json_extract_string(first, '$.score_a')
                                                   else json_extract_string(first, '$.summary_a_score') end as double)
         when t_ok then try_cast(regexp_extract(response, '{J.TEXT_AB}', 1) as double)
         when len(nums) >= 2 and len(small) >= 2 then try_cast(small[1] as double) end as base_score,
    case when first is not null then try_cast(case when {_F_AB} then json_extract_string(first, '$.score_b')
                                                   else json_extract_string(first, '$.summary_b_score') end as double)
         when t_ok then try_cast(regexp_extract(response, '{J.TEXT_AB}', 2) as double)
         when len(nums) >= 2 and len(small) >= 2 then try_cast(small[2] as double) end as finetuned_score,
    case when first is not null then coalesce(json_extract_string(first, '$.explanation'), '')
         when t_ok then '{J.MSG_TEXT}'
         when len(nums) >= 2 and len(small) >= 2 then '{J.MSG_NUMERIC}'
         else '{J.MSG_FAILED}' end as explanation,
    case when first is not null then 'json' when t_ok then 'text'
         when len(nums) >= 2 and len(small) >= 2 then 'numeric' else 'failed' end as parse_path
  from g)
select doc_id, language as run, base_score, finetuned_score, explanation, parse_path,
       finetuned_score - base_score as improvement
from s"""


def _parsed(t):
    r = FX.judge_responses(t).withColumnRenamed("language", "run")
    return JO.parse_judge_scores(r)


@register("parse_judge_scores", rsql(PARSED_SQL, "base_score,finetuned_score,improvement", ("judge_responses",)))
def parse_judge_scores(t):
    return _parsed(t).select("doc_id", "run", "base_score", "finetuned_score", "explanation", "parse_path",
                             "improvement")


@register("judge_improvement", rsql(f"select doc_id, improvement from ({PARSED_SQL}) p", "improvement",
                                    ("judge_responses",)))
def judge_improvement(t):
    return _parsed(t).select("doc_id", "improvement")


@register("judge_statistics", rsql(f"""
select run, avg(base_score) filter (where v) as average_base_score,
       avg(finetuned_score) filter (where v) as average_finetuned_score,
       avg(finetuned_score - base_score) filter (where v) as average_improvement,
       case when count(*) filter (where v) > 0
            then (count(*) filter (where v and finetuned_score > base_score)) / (count(*) filter (where v)) end as win_rate,
       case when count(*) filter (where v) > 0
            then (count(*) filter (where v and finetuned_score = base_score)) / (count(*) filter (where v)) end as tie_rate,
       case when count(*) filter (where v) > 0
            then (count(*) filter (where v and finetuned_score < base_score)) / (count(*) filter (where v)) end as loss_rate,
       count(*) filter (where v) as valid_evaluations, count(*) as total_evaluations,
       case when count(*) filter (where v) = 0 then 'No valid evaluation results' end as error
from (select *, base_score is not null and finetuned_score is not null as v from ({PARSED_SQL}) p) q
group by run""", "average_base_score,average_finetuned_score,average_improvement,win_rate,tie_rate,loss_rate",
        ("judge_responses",)))
def judge_statistics(t):
    return JO.judge_statistics(_parsed(t))


@register("judge_parse_audit", rsql(f"select run, parse_path, count(*) as n from ({PARSED_SQL}) p group by all",
                                    "", ("judge_responses",)))
def judge_parse_audit(t):
    return JO.judge_parse_audit(_parsed(t))


@register("judge_prompt", rsql(f"""
select article_id, language,
       {P.sql_fill(P.JUDGE_TEMPLATE, title='title', reference='summary',
                   summary_a="split_part(text, chr(10), 3)",
                   summary_b="concat_ws(' ', split_part(text, chr(10), 1), split_part(text, chr(10), 2))")}
         as prompt
from pairs""", "", ("pairs",)))
def judge_prompt(t):
    p = FX.pairs(t)
    line = lambda n: F.split_part(F.col("text"), F.lit("\n"), F.lit(n))
    return p.select("article_id", "language",
                    P.judge_prompt("title", "summary", line(3), F.concat_ws(" ", line(1), line(2))).alias("prompt"))
