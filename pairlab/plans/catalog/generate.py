"""User-function slot queries: batched maps, generators, judges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pairlab.functions import prompts as P
from pairlab.operators import generate as G
from pairlab.plans import fixtures as FX
from pairlab.plans.catalog.base import register, rsql
from pairlab.plans.catalog.metrics import lcs_sql, rouge_doubles, rouge_sql


def _lengths(b: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"article_id": b["article_id"], "language": b["language"],
                         "n_chars": b["text"].str.len().astype("int64"),
                         "n_words": b["text"].map(lambda s: len(s.split())).astype("int64")})


@register("map_batched", rsql("""
select article_id, language, cast(length(text) as bigint) as n_chars,
       cast(len(regexp_extract_all(text, '\\S+')) as bigint) as n_words from pairs""", "", ("pairs",)))
def map_batched(t):
    return G.map_batched(FX.pairs(t).select("article_id", "language", "text"), _lengths,
                         "article_id string, language string, n_chars bigint, n_words bigint")


@register("filter_rows", rsql("select doc_id from documents where length(text) >= 1000"))
def filter_rows(t):
    return G.filter_rows(t.documents.select("doc_id", "text"), lambda s: s.str.len() >= 1000, "text").select("doc_id")


def lead_sql(col: str, k: int) -> str:
    return (f"array_to_string(string_split(regexp_replace({col}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
            f"[1:{k}], ' ')")


@register("generate_batch", rsql(f"select article_id, language, {lead_sql('text', 2)} as generated from pairs",
                                 "", ("pairs",)))
def generate_batch(t):
    p = FX.pairs(t).select("article_id", "language", F.col("text").alias("prompt"))
    return G.generate_batch(p, G.lead_sentences(2), "prompt", "generated", "empty").select(
        "article_id", "language", "generated")


def _judge_input(t):
    g = FX.generations(t)
    w = (g.groupBy("article_id", "language")
         .agg(F.max(F.when(F.col("model") == "base", F.col("generated"))).alias("a"),
              F.max(F.when(F.col("model") == "finetuned", F.col("generated"))).alias("b"),
              F.first("reference").alias("reference"), F.first("title").alias("title")))
    return w


JUDGE_N = 20  # pairs in a comparison or result document


def judge_chunks(t):
    """The judge's input, numbered per language from 0 (``index``) and dealt into documents of n pairs (``part``)."""
    from pairlab.operators.ranking import ranked
    j = ranked(_judge_input(t), ["language"], [F.col("article_id")], F.substring("article_id", 1, 3), name="index")
    j = j.withColumn("index", F.col("index") - 1)
    return j.withColumn("part", F.floor(F.col("index") / JUDGE_N))


def _overlap_sql(x: str) -> str:
    a = f"list_filter(list_distinct(string_split_regex(lower({x}), '\\s+')), lambda w: w <> '')"
    r = "list_filter(list_distinct(string_split_regex(lower(reference), '\\s+')), lambda w: w <> '')"
    return (f"case when len({a}) = 0 or len({r}) = 0 then 1 else "
            f"1 + least(4, cast(floor(2.0 * len(list_intersect({a}, {r})) / (len({a}) + len({r})) * 5) as bigint)) end")


@register("judge_batch", rsql(f"""
with w as (select article_id, language, max(generated) filter (where model = 'base') as a,
                  max(generated) filter (where model = 'finetuned') as b, max(reference) as reference
           from generations group by all)
select article_id, language, cast({_overlap_sql('a')} as double) as base_score,
       cast({_overlap_sql('b')} as double) as finetuned_score, 'word overlap' as explanation, 'json' as parse_path
from w""", "base_score,finetuned_score", ("generations",)))
def judge_batch(t):
    j = _judge_input(t).withColumn("judge_prompt", P.judge_prompt("title", "reference", "a", "b"))
    out = G.judge_batch(j.select("article_id", "language", "judge_prompt"), G.overlap_judge())
    return out.select("article_id", "language", "base_score", "finetuned_score", "explanation", "parse_path")


_CMP_GENS = f"""gens as (
  select article_id, language, 'lead1' as model, {lead_sql('text', 1)} as generated, summary as reference from pairs
  union all
  select article_id, language, 'lead3' as model, {lead_sql('text', 3)} as generated, summary as reference from pairs)"""


@register("compare_models", rsql(f"""with {_CMP_GENS}
select s.*, g.generated, l.rougeL_f from ({rouge_sql('gens', ['article_id', 'language', 'model'])}) s
join gens g using (article_id, language, model)
join ({lcs_sql('gens', ['article_id', 'language', 'model'])}) l using (article_id, language, model)""",
                                 rouge_doubles() + ",rougeL_f", ("pairs",)))
def compare_models(t):
    p = FX.pairs(t).select("article_id", "language", F.col("text").alias("prompt"), F.col("summary").alias("reference"))
    return G.compare_models(p, {"lead1": G.lead_sentences(1), "lead3": G.lead_sentences(3)},
                            ["article_id", "language"])
