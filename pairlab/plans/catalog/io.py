"""Source/sink round trips over data derived from the driver tables.

Each query writes with the library's writer into a fresh folder under the
shared checkpoint directory (``spark.checkpoint.dir``), reads it back with
the matching reader and returns the rows.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import functions as F

from pairlab.operators import corpus as C
from pairlab.operators import generate as G
from pairlab.operators import metrics as M
from pairlab.operators import profile as PR
from pairlab.plans import fixtures as FX
from pairlab.plans.catalog.base import register, rsql
from pairlab.plans.catalog.generate import _overlap_sql, lead_sql
from pairlab.plans.catalog.metrics import GKEYS, rouge_sql
from pairlab.plans.catalog.sqlbits import LENGTH_STATS
from pairlab.session import scratch_path
from pairlab.sources import readers as R
from pairlab.sources import writers as W
from pairlab.streaming import incremental as INC


def _fresh(t, name: str) -> str:
    return scratch_path(t.spark, f"{name}-{uuid.uuid4().hex[:12]}")


_PAR_SQL = """
select source as id, lang as language, arg_min(split_part(text, chr(10), 1), doc_id) as title,
       arg_min(concat('https://', lang, '.example.org/wiki/', replace(split_part(text, chr(10), 1), ' ', '_')), doc_id)
         as url
from documents where length(text) >= 1000 group by source, lang"""


def _parallel_rows(t):
    a = FX.sourced_articles(t).filter(F.length("text") >= 1000)
    return (a.groupBy(F.col("source").alias("id"), "language")
            .agg(F.min_by("title", "doc_id").alias("title"), F.min_by("url", "doc_id").alias("url")))


@register("write_index", rsql(f"""
select id, string_agg(language || '=' || title, '|' order by language) as titles,
       string_agg(language || '=' || url, '|' order by language) as urls, count(*) as n_languages
from ({_PAR_SQL}) p group by id"""))
def write_index(t):
    path = _fresh(t, "index")
    W.write_index(_parallel_rows(t), path)
    back = t.spark.read.schema(R.INDEX_SCHEMA).json(path)
    def flat(m):
        return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return back.select("id", flat(F.col("titles")).alias("titles"), flat(F.col("urls")).alias("urls"),
                       F.size("titles").cast("bigint").alias("n_languages"))


_DATASET = ["article_id", "language", "split", "title", "url", "text", "summary"]


@register("read_split_dataset", rsql("select article_id, language, split, title, url, text, summary from dataset where language = 'en' and split = 'train'",
                                     "", ("dataset",)))
def read_split_dataset(t):
    path = _fresh(t, "dataset")
    W.write_split_dataset(FX.dataset(t).select(*_DATASET), path)
    return R.read_split_dataset(t.spark, path, "en", "train").select(*_DATASET)


@register("write_articles", rsql("select article_id, language, title, url, text from articles", "", ("articles",)))
def write_articles(t):
    path = _fresh(t, "articles")
    W.write_articles(FX.articles(t).select("article_id", "language", "title", "url", "text"), path)
    return t.spark.read.parquet(path).select("article_id", "language", "title", "url", "text")


@register("write_summaries", rsql("select article_id, language, summary from summaries", "", ("summaries",)))
def write_summaries(t):
    path = _fresh(t, "summaries")
    W.write_summaries(FX.summaries(t).select("article_id", "language", "summary"), path)
    return t.spark.read.parquet(path).select("article_id", "language", "summary")


@register("write_metrics_csv", rsql(f"""
select model, avg(rouge1_f) as rouge1_f, avg(rouge2_f) as rouge2_f
from ({rouge_sql('generations', GKEYS)}) s
group by model""", "rouge1_f,rouge2_f", ("generations",)))
def write_metrics_csv(t):
    path = _fresh(t, "metrics_csv")
    means = M.mean_rouge(M.rouge_scores(FX.generations(t), GKEYS)).select("model", "rouge1_f", "rouge2_f")
    W.write_metrics_csv(means, path)
    return t.spark.read.option("header", True).schema("model string, rouge1_f double, rouge2_f double").csv(path)


@register("write_stats_json", rsql(f"""
select language, split, text_tokens_mean, text_tokens_median, text_tokens_max
from ({LENGTH_STATS}) s""",
        "text_tokens_mean,text_tokens_median", ("dataset",)))
def write_stats_json(t):
    path = _fresh(t, "stats_json")
    stats = PR.length_stats(FX.dataset(t))
    W.write_stats_json(stats, path, ["language", "split"],
                       {"text_tokens": ["text_tokens_mean", "text_tokens_median", "text_tokens_max"]})
    back = t.spark.read.schema("language string, split string, stats string").json(path)
    st = F.from_json("stats", "text_tokens struct<text_tokens_mean: double, text_tokens_median: double, "
                              "text_tokens_max: bigint>")
    return back.select("language", "split", st["text_tokens"]["text_tokens_mean"].alias("text_tokens_mean"),
                       st["text_tokens"]["text_tokens_median"].alias("text_tokens_median"),
                       st["text_tokens"]["text_tokens_max"].alias("text_tokens_max"))


@register("write_run_metadata", rsql("""
select count(*) as total_rows, array_to_string(list_sort(list_distinct(list(language))), ',') as languages,
       count(*) filter (where split = 'train') as n_train, count(*) filter (where split = 'validation') as n_validation,
       count(*) filter (where split = 'test') as n_test, '{"seed": 42}' as config, '2024-01-01T00:00:00' as created_at
from dataset""", "", ("dataset",)))
def write_run_metadata(t):
    path = _fresh(t, "metadata")
    W.write_run_metadata(FX.dataset(t), path, {"seed": 42}, "2024-01-01T00:00:00")
    m = t.spark.read.schema("total_rows bigint, languages array<string>, n_train bigint, n_validation bigint, "
                            "n_test bigint, config string, created_at string").json(path)
    return m.select("total_rows", F.array_join("languages", ",").alias("languages"), "n_train", "n_validation",
                    "n_test", "config", "created_at")


_CMP_N = 20


@register("read_comparisons", rsql(f"""
select pos, title, reference_summary, base_model_summary, finetuned_model_summary, 'fr' as language
from (select row_number() over (order by article_id, language) - 1 as pos, title, reference_summary,
             base_model_summary, finetuned_model_summary
      from (select g.article_id, g.language, max(p.title) as title, max(g.reference) as reference_summary,
                   max(g.generated) filter (where g.model = 'base') as base_model_summary,
                   max(g.generated) filter (where g.model = 'finetuned') as finetuned_model_summary
            from generations g join pairs p using (article_id, language) group by all) w) x
where pos < {_CMP_N}""", "", ("generations", "pairs")))
def read_comparisons(t):
    """Write the first n comparisons as one nested report file (the reference's
    layout; n bounds the nested array) and read them back."""
    path = _fresh(t, "comparisons")
    sbs = M.side_by_side(FX.generations(t), ["article_id", "language"], ["base", "finetuned"])
    ref = FX.pairs(t).select("article_id", "language", "title", F.col("summary").alias("reference_summary"))
    rows = sbs.join(ref, ["article_id", "language"])
    first = C.limit_in_order(rows, _CMP_N, ["article_id", "language"])
    doc = first.agg(F.sort_array(F.collect_list(F.struct(
        "article_id", "language", F.col("title"), F.col("reference_summary"),
        F.col("base").alias("base_model_summary"), F.col("finetuned").alias("finetuned_model_summary")))).alias("c"))
    doc = doc.select(F.create_map(F.lit("language"), F.lit("fr")).alias("config"),
                     F.transform("c", lambda x, i: F.struct(i.cast("bigint").alias("index"), x["title"].alias("title"),
                                                            F.lit(None).cast("string").alias("text"),
                                                            x["reference_summary"].alias("reference_summary"),
                                                            x["base_model_summary"].alias("base_model_summary"),
                                                            x["finetuned_model_summary"].alias("finetuned_model_summary")))
                     .alias("comparisons"))
    doc.coalesce(1).write.mode("overwrite").json(path)
    back = R.read_comparisons(t.spark, path, _CMP_N)
    return back.select(F.col("pos").cast("bigint").alias("pos"), "title", "reference_summary", "base_model_summary",
                       "finetuned_model_summary", F.col("config")["language"].alias("language"))


@register("incremental_ingest", rsql("""
select split_part(text, chr(10), 1) as name, min(doc_id) as doc_id, arg_min(text, doc_id) as text from documents group by 1"""))
def incremental_ingest(t):
    """Stream documents into a page store keeping the row with the lowest id per page
    name; run twice -- the second run adds nothing."""
    base = _fresh(t, "ingest")
    src = os.path.join(base, "in")
    FX.articles(t).select(F.col("title").alias("name"), "doc_id", "text").write.parquet(src)
    out, ck = os.path.join(base, "out"), os.path.join(base, "ck")
    for _ in range(2):
        q = INC.incremental_ingest(t.spark, src, "name string, doc_id bigint, text string", "name", ck, out,
                                   order="doc_id")
        q.awaitTermination()
    return t.spark.read.parquet(out).select("name", "doc_id", "text")


@register("incremental_generate", rsql(f"""
select article_id, language, {lead_sql('text', 2)} as generated
from articles a
where not exists (select 1 from summaries s where s.article_id = a.article_id and s.language = a.language)"""
                                       , "", ("articles", "summaries")))
def incremental_generate(t):
    """Generate for articles without a summary; the second run appends 0 rows."""
    out = _fresh(t, "gen")
    todo = C.resume_anti_join(FX.articles(t), FX.summaries(t), ["article_id", "language"]).select(
        "article_id", "language", F.col("text").alias("prompt"))
    for _ in range(2):
        INC.incremental_generate(t.spark, todo, ["article_id", "language"], G.lead_sentences(2), out)
    return t.spark.read.parquet(out)


@register("write_split_dataset", rsql("select article_id, language, split, title, url, text, summary from dataset", "", ("dataset",)))
def write_split_dataset(t):
    path = _fresh(t, "split_dataset")
    W.write_split_dataset(FX.dataset(t).select(*_DATASET), path)
    return t.spark.read.parquet(path).select(*_DATASET)


@register("rewrite_or_copy", rsql("select article_id, language, split_part(summary, chr(10), 1) as summary from summaries",
                                  "", ("summaries",)))
def rewrite_or_copy(t):
    """Clean summaries in place: staging copy + directory swap."""
    from pairlab.plans.flagships import clean_summaries
    path = _fresh(t, "summaries_inplace")
    FX.summaries(t).select("article_id", "language", "summary").write.parquet(path)
    W.rewrite_or_copy(clean_summaries(t.spark.read.parquet(path)), path)
    return t.spark.read.parquet(path)


@register("write_comparison_report", rsql(f"""
select s.article_id, s.language, s.model, g.generated, s.rouge1_f, s.rouge2_f
from ({rouge_sql('generations', GKEYS)}) s
join generations g using (article_id, language, model)""", "rouge1_f,rouge2_f", ("generations",)))
def write_comparison_report(t):
    path = _fresh(t, "report")
    g = FX.generations(t)
    rows = M.rouge_all(g, GKEYS, lcs=False, carry=["generated"]).select(*GKEYS, "generated", "rouge1_f", "rouge2_f")
    W.write_comparison_report(rows, path, {"models": ["base", "finetuned"]}, M.mean_rouge(rows))
    return t.spark.read.parquet(os.path.join(path, "comparisons"))


@register("read_judge_results", rsql(f"""
with w as (select article_id, language, max(generated) filter (where model = 'base') as a,
                  max(generated) filter (where model = 'finetuned') as b, max(reference) as reference
           from generations group by all),
r as (select *, row_number() over (partition by language order by article_id) - 1 as idx from w)
select 'overlap-judge' as judge_model, language, 'test' as subset, idx as "index", article_id as title,
       cast({_overlap_sql('a')} as double)
         as base_score,
       cast({_overlap_sql('b')} as double)
         as finetuned_score
from r""", "base_score,finetuned_score", ("generations",)))
def read_judge_results(t):
    """Judge all pairs, write them as result documents of n pairs each and read all
    of them back."""
    from pairlab.functions import prompts as P
    from pairlab.plans.catalog.generate import judge_chunks
    path = _fresh(t, "judge_files")
    j = judge_chunks(t).withColumn("judge_prompt", P.judge_prompt("title", "reference", "a", "b"))
    judged = G.judge_batch(j, G.overlap_judge())
    docs = (judged.groupBy("language", "part").agg(F.sort_array(F.collect_list(F.struct(
        "index", F.col("article_id").alias("title"), "base_score", "finetuned_score", "explanation",
        "improvement"))).alias("evaluation_results"))
        .select(F.lit("overlap-judge").alias("model"),
                F.create_map(F.lit("language"), F.col("language"), F.lit("subset"), F.lit("test")).alias("config"),
                "evaluation_results"))
    docs.write.json(path)
    back = R.read_judge_results(t.spark, path, json_lines=True)
    return back.select("judge_model", "language", "subset", "index", "title", "base_score", "finetuned_score")


@register("read_articles", rsql("""
select article_id, language, title, text, url from articles""", "", ("articles",)))
def read_articles(t):
    """Articles as JSON lines by language, read back."""
    path = _fresh(t, "article_files")
    W.write_records(FX.articles(t).select("article_id", "language", "title", "text", "url"), path)
    good, _bad = R.read_articles(t.spark, path, layout="lines")
    return good


@register("read_summaries", rsql("""
select article_id, language, summary, title from summaries""", "", ("summaries",)))
def read_summaries(t):
    path = _fresh(t, "summary_files")
    W.write_records(FX.summaries(t).select("article_id", "language", "summary", "title"), path)
    good, _bad = R.read_summaries(t.spark, path, layout="lines")
    return good


@register("read_article_index", rsql(f"""
select id, string_agg(language || '=' || title, '|' order by language) as titles, count(*) as n_languages
from ({_PAR_SQL}) p group by id"""))
def read_article_index(t):
    path = _fresh(t, "index_lines")
    W.write_index(_parallel_rows(t), path)
    back = R.read_article_index(t.spark, path, json_lines=True)
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("titles")),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return back.select("id", flat.alias("titles"), F.size("titles").cast("bigint").alias("n_languages"))
