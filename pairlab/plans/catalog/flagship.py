"""Flagship compositions."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pairlab.operators import generate as G
from pairlab.plans import fixtures as FX
from pairlab.plans import flagships as FL
from pairlab.plans.catalog.base import register, rsql
from pairlab.plans.catalog.generate import _CMP_GENS, JUDGE_N, _overlap_sql, judge_chunks
from pairlab.plans.catalog.io import _fresh
from pairlab.plans.catalog.metrics import _LEN_D, report_sql
from pairlab.sources import readers as R
from pairlab.sources import writers as W


@register("build_parallel_corpus", rsql("""
with bp as (select * from base_pages where language = 'en'),
capped as (select * from (select *, row_number() over (partition by category order by pos) as rk from bp) where rk <= 30),
seen as (select name as page, arg_min(category_rank, [category_rank, pos]) as category_rank,
                arg_min(pos, [category_rank, pos]) as pos, arg_min(namespace, [category_rank, pos]) as namespace
         from capped group by name),
base as (select page, category_rank, pos from seen where namespace = 0),
a as (select a.*, d.source from articles a join documents d using (doc_id)),
lbase as (select source, arg_min(title, doc_id) as page from a where language = 'en' group by source),
links as (select b.page, a.language as lang, a.title as target, a.doc_id as position
          from a join lbase b using (source) where a.language <> 'en'),
best as (select page, lang, arg_max(target, position) as target from links
         where page in (select page from base) group by page, lang),
lp as (select language, title, min(doc_id) as doc_id from articles group by all),
lpt as (select lp.*, a.text from lp join articles a using (doc_id)),
foreign_rows as (select b.page, b.lang, p.doc_id, p.text from best b join lpt p on p.language = b.lang and p.title = b.target),
own as (select b.page, 'en' as lang, p.doc_id, p.text from base b join lpt p on p.language = 'en' and p.title = b.page),
r as (select * from foreign_rows union all select * from own),
valid as (select * from r where lang in ('en', 'fr', 'de', 'es') and length(text) >= 1000),
complete as (select page from valid group by page having count(distinct lang) = 4)
select substr(md5(page), 1, 10) as article_id, page, lang as language, doc_id
from valid where page in (select page from complete)""", "", ("articles", "base_pages")))
def build_parallel_corpus(t):
    base, links = FX.base_links(t)
    lp = FX.lang_pages(t, lengths_only=True)
    return FL.build_parallel_corpus(FX.base_pages(t), links, lp, ["en", "fr", "de", "es"])


@register("build_pair_dataset", rsql(f"""
select article_id, language, title, url, text, summary, n as n_language, b.total as n_all,
       case when r <= nt then 'test' when r <= nt + ceil((n - nt) * cast({repr(0.1 / 0.9)} as double))
            then 'validation' else 'train' end as split
from (select *, ceil(n * cast({repr(0.1)} as double)) as nt
      from (select *, row_number() over (partition by language order by md5(concat('42:', article_id)), article_id) as r,
                   count(*) over (partition by language) as n, count(*) over () as total from pairs) a) b""", "", ("pairs",)))
def build_pair_dataset(t):
    """Index, articles and summaries as files -> the dataset and its metadata as files."""
    base = _fresh(t, "pair_dataset")
    path = lambda name: os.path.join(base, name)
    a = FX.articles(t)
    W.write_index(a.select(F.col("article_id").alias("id"), "language", "title", "url"), path("index"))
    W.write_records(a.select("article_id", "language", "title", "text", "url"), path("articles"))
    W.write_records(FX.summaries(t), path("summaries"))
    d = FL.build_pair_dataset_files(t.spark, path("index"), path("articles"), path("summaries"), path("out"),
                                    "2024-01-01T00:00:00")
    meta = t.spark.read.schema("total_rows bigint, article_counts map<string, bigint>").json(path("out/metadata"))
    sizes = meta.select(F.explode("article_counts").alias("language", "n_language"), F.col("total_rows").alias("n_all"))
    return d.join(sizes, "language")


@register("clean_summaries", rsql("select article_id, language, split_part(summary, chr(10), 1) as summary, title from summaries",
                                  "", ("summaries",)))
def clean_summaries(t):
    """Summary files -> cleaned copies of them."""
    src, dst = _fresh(t, "summaries_raw"), _fresh(t, "summaries_clean")
    W.write_records(FX.summaries(t), src)
    FL.clean_summary_files(t.spark, src, dst)
    return R.read_summaries(t.spark, dst, layout="lines")[0]


_REPORT = ["rouge1_p", "rouge1_r", "rouge1_f", "rouge2_p", "rouge2_r", "rouge2_f", "rougeL_f", "rougeLsum_f",
           *_LEN_D.split(",")]


@register("evaluate_models", rsql(f"""with {_CMP_GENS},
report as ({report_sql('gens')}),
shown as (select * from pairs order by md5(concat('42:', article_id)), article_id limit 10)
select 'metric' as part, model, item, value, cast(null as varchar) as text
from (unpivot report on {', '.join(_REPORT)} into name item value value)
union all
select 'example', case s.model when 'lead1' then 'summary_lead1' else 'summary_lead3' end, article_id, null, s.generated
from gens s where article_id in (select article_id from shown)
union all
select 'example', 'source', article_id, null, concat(left(text, 1000), '...') from shown
union all
select 'example', 'reference', article_id, null, summary from shown""", "value", ("pairs",)))
def evaluate_models(t):
    """Two generators on all pairs; the metrics CSV and the examples read back as one long table."""
    out = _fresh(t, "evaluation")
    p = FX.pairs(t).select("article_id", "language", F.col("text").alias("prompt"), F.col("summary").alias("reference"))
    FL.evaluate_models(p, {"lead1": G.lead_sentences(1), "lead3": G.lead_sentences(3)}, ["article_id", "language"], out=out)
    schema = "model string, " + ", ".join(f"{c} double" for c in _REPORT)
    metrics = t.spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(os.path.join(out, "metrics"))
    metrics = metrics.unpivot("model", _REPORT, "item", "value").select(
        F.lit("metric").alias("part"), "model", "item", "value", F.lit(None).cast("string").alias("text"))
    shown = ["source", "reference", "summary_lead1", "summary_lead3"]
    examples = t.spark.read.schema("article_id string, " + ", ".join(f"{c} string" for c in shown)).json(os.path.join(out, "examples"))
    examples = examples.unpivot("article_id", shown, "model", "text").select(
        F.lit("example").alias("part"), "model", F.col("article_id").alias("item"), F.lit(None).cast("double").alias("value"), "text")
    return metrics.union(examples)


@register("judge_report", rsql(f"""
with w0 as (select article_id, language, max(generated) filter (where model = 'base') as a,
                  max(generated) filter (where model = 'finetuned') as b, max(reference) as reference
            from generations group by all),
w as (select *, floor((row_number() over (partition by language order by article_id) - 1) / {JUDGE_N}) as part from w0),
s as (select language, cast(part as bigint) as part, cast({_overlap_sql('a')} as double) as base_score,
             cast({_overlap_sql('b')} as double) as finetuned_score from w)
select 'overlap-judge' as judge_model, language, part, avg(base_score) as average_base_score, avg(finetuned_score) as average_finetuned_score,
       avg(finetuned_score - base_score) as average_improvement,
       (count(*) filter (where finetuned_score > base_score)) / count(*) as win_rate,
       (count(*) filter (where finetuned_score = base_score)) / count(*) as tie_rate,
       (count(*) filter (where finetuned_score < base_score)) / count(*) as loss_rate,
       count(*) as valid_evaluations, count(*) as total_evaluations, cast(null as varchar) as error
from s group by language, part""", "average_base_score,average_finetuned_score,average_improvement,win_rate,tie_rate,"
                             "loss_rate", ("generations",)))
def judge_report(t):
    """All comparisons as documents of n pairs -> judged documents with statistics for each."""
    src, out = _fresh(t, "comparison_docs"), _fresh(t, "judge_docs")
    rows = judge_chunks(t).groupBy("language", "part").agg(F.sort_array(F.collect_list(F.struct(
        "index", "title", F.col("reference").alias("reference_summary"), F.col("a").alias("base_model_summary"),
        F.col("b").alias("finetuned_model_summary")))).alias("comparisons"))
    config = F.create_map(F.lit("language"), F.col("language"), F.lit("part"), F.col("part").cast("string"))
    rows.select(config.alias("config"), "comparisons").write.json(src)
    stats = FL.judge_report_files(t.spark, src, out, G.overlap_judge(), "overlap-judge", n=JUDGE_N)
    return stats.select("judge_model", F.col("config")["language"].alias("language"),
                        F.col("config")["part"].cast("bigint").alias("part"), *[c for c in stats.columns if c not in ("judge_model", "config")])
