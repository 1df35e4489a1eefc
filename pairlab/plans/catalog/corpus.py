"""Corpus assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import prompts as P
from pairlab.functions import text as T
from pairlab.operators import corpus as C
from pairlab.plans import fixtures as FX
from pairlab.plans.catalog import sqlbits as Q
from pairlab.plans.catalog.base import register, rsql


@register("filter_namespace", rsql("select name, category, pos from base_pages where namespace = 0",
                                   "", ("base_pages",)))
def filter_namespace(t):
    return C.filter_namespace(FX.base_pages(t)).select("name", "category", "pos")


@register("filter_min_length", rsql("select doc_id from documents where length(text) >= 1000"))
def filter_min_length(t):
    return C.filter_min_length(t.documents, 1000).select("doc_id")


@register("filter_short_pairs", rsql("""
select article_id, language from dataset where length(text) >= 100 and length(summary) >= 10""",
                                     "", ("dataset",)))
def filter_short_pairs(t):
    return C.filter_short_pairs(FX.dataset(t), 100, 10).select("article_id", "language")


@register("trim_long_summaries", rsql("select article_id, language, substr(summary, 1, 2000) as summary from pairs",
                                      "", ("pairs",)))
def trim_long_summaries(t):
    return C.trim_long_summaries(FX.pairs(t), 2000).select("article_id", "language", "summary")


@register("prepare_pairs", rsql("""
select split, count(*) as n_rows from dataset
where length(text) >= 100 and length(substr(summary, 1, 2000)) >= 10 group by split""", "", ("dataset",)))
def prepare_pairs(t):
    return C.prepare_pairs(FX.dataset(t))


@register("join_article_summary", rsql("select article_id, language, title, url, summary from pairs",
                                       "", ("pairs",)))
def join_article_summary(t):
    return FX.pairs(t).select("article_id", "language", "title", "url", "summary")


@register("join_audit", rsql(f"""
select a.language, case when a.text is null or {Q.strip('a.text')} = '' then 'missing content'
                        when s.summary is not null and s.summary <> '' then 'ok'
                        else 'missing summary' end as outcome, count(*) as n
from articles a left join summaries s on a.article_id = s.article_id and a.language = s.language
group by all""", "", ("articles", "summaries")))
def join_audit(t):
    return C.join_audit_counts(C.join_audit(FX.articles(t), FX.summaries(t)))


@register("resolve_langlinks", rsql("""
with a as (select a.*, d.source from articles a join documents d using (doc_id)),
base as (select source, arg_min(title, doc_id) as page from a where language = 'en' group by source),
links as (select b.page, a.language as lang, a.title as target, a.doc_id as position
          from a join base b using (source) where a.language <> 'en'),
best as (select page, lang, arg_max(target, position) as target, max(position) as position
         from links group by page, lang),
pages as (select language as lang, title as target, min(doc_id) as doc_id from articles group by all)
select b.page, b.lang, b.target, b.position, p.doc_id from best b join pages p using (lang, target)""",
                                    "", ("articles",)))
def resolve_langlinks(t):
    base, links = FX.base_links(t)
    pages = FX.lang_pages(t).select("language", "title", "doc_id")
    return C.resolve_langlinks(base, links, pages).select("page", "lang", "target", "position", "doc_id")


@register("parallel_complete", rsql("""
select source as id, lang as language, min(doc_id) as doc_id
from documents
where lang in ('en', 'fr', 'de', 'es') and length(text) >= 1000
  and source in (select source from documents where lang in ('en', 'fr', 'de', 'es') and length(text) >= 1000
                 group by source having count(distinct lang) = 4)
group by source, lang"""))
def parallel_complete(t):
    d = t.documents.select(F.col("source").alias("id"), F.col("lang").alias("language"), "doc_id", "text")
    kept = C.parallel_complete(d, ["en", "fr", "de", "es"], min_len=1000)
    return kept.groupBy("id", "language").agg(F.min("doc_id").alias("doc_id"))


@register("resume_anti_join", rsql("""
select article_id, language from articles a
where not exists (select 1 from summaries s where s.article_id = a.article_id and s.language = a.language)""",
                                   "", ("articles", "summaries")))
def resume_anti_join(t):
    return C.resume_anti_join(FX.articles(t), FX.summaries(t), ["article_id", "language"]).select(
        "article_id", "language")


@register("pending_keys", rsql("""
select article_id, language from articles except select article_id, language from pairs""",
                               "", ("articles", "pairs")))
def pending_keys(t):
    return C.pending_keys(FX.articles(t), FX.pairs(t), ["article_id", "language"])


@register("zip_by_position", rsql("""
select g.article_id, g.language, g.generated, p.summary as reference
from generations g join pairs p using (article_id, language) where g.model = 'finetuned'""",
                                  "", ("generations", "pairs")))
def zip_by_position(t):
    g = FX.generations(t).filter(F.col("model") == "finetuned").select("article_id", "language", "generated")
    p = FX.pairs(t).select("article_id", "language", F.col("summary").alias("reference"))
    return C.zip_by_position(g, p, ["article_id", "language"])


def _templates_sql() -> str:
    rows = ", ".join(f"({P.sql_literal(l)}, {P.sql_literal(tp)})" for l, _, tp in P.template_rows("generate"))
    return f"(values {rows})"


@register("prompt_template_join", rsql(f"""
select p.article_id, p.language, coalesce(t.template, f.template) as template
from pairs p left join {_templates_sql()} t(tlang, template) on t.tlang = p.language
left join (select template from {_templates_sql()} v(tlang, template) where tlang = '*') f on true""",
        "", ("pairs",)))
def prompt_template_join(t):
    spark = t.spark
    j = C.prompt_template_join(FX.pairs(t), P.template_table(spark).select("language", "template"),
                               fallback="*")
    return j.select("article_id", "language", "template")


@register("summary_prompt", rsql(f"""
select article_id, language,
       replace(replace(template, '{{language}}', language), '{{text}}', left(text, 4096)) as prompt
from (select p.article_id, p.language, p.text, coalesce(t.template, f.template) as template
      from pairs p left join {_templates_sql()} t(tlang, template) on t.tlang = p.language
      left join (select template from {_templates_sql()} v(tlang, template) where tlang = '*') f on true) x""",
        "", ("pairs",)))
def summary_prompt(t):
    p = P.summary_prompt(FX.pairs(t), P.template_table(t.spark), max_chars=4096)
    return p.select("article_id", "language", "prompt")


@register("model_cross_join", rsql("""
select article_id, language, m.model from pairs, (values ('base'), ('finetuned')) m(model)""",
                                   "", ("pairs",)))
def model_cross_join(t):
    return C.model_cross_join(FX.pairs(t).select("article_id", "language"), ["base", "finetuned"])


@register("dedupe_first_seen", rsql("""
select name, arg_min(category, [category_rank, pos]) as category, arg_min(pos, [category_rank, pos]) as pos
from base_pages group by name""", "", ("base_pages",)))
def dedupe_first_seen(t):
    return C.dedupe_first_seen(FX.base_pages(t), "name", ("category_rank", "pos")).select("name", "category", "pos")


@register("cap_per_category", rsql("""
select name, category, pos, rank from (
  select name, category, pos, row_number() over (partition by category order by pos) as rank from base_pages)
where rank <= 30""", "", ("base_pages",)))
def cap_per_category(t):
    return C.cap_per_category(FX.base_pages(t), 30).select("name", "category", "pos", "rank")


@register("cap_per_language", rsql("""
select article_id, language, rank from (
  select article_id, language, row_number() over (partition by language order by doc_id) as rank from pairs)
where rank <= 50""", "", ("pairs",)))
def cap_per_language(t):
    return C.cap_per_language(FX.pairs(t), 50, order=("doc_id",)).select("article_id", "language", "rank")


@register("cap_shortage", rsql("""
select language, count(*) as collected, cast(50 as bigint) as requested, count(*) < 50 as shortage
from (select language, row_number() over (partition by language order by doc_id) as rank from pairs)
where rank <= 50 group by language""", "", ("pairs",)))
def cap_shortage(t):
    return C.cap_shortage(C.cap_per_language(FX.pairs(t), 50, order=("doc_id",)), 50)


@register("limit_in_order", rsql("select article_id, doc_id from articles order by doc_id limit 100",
                                 "", ("articles",)))
def limit_in_order(t):
    return C.limit_in_order(FX.articles(t).select("article_id", "doc_id"), 100, ["doc_id"])


@register("select_first_n", rsql("select article_id, language from pairs order by article_id limit 50",
                                 "", ("pairs",)))
def select_first_n(t):
    return C.select_first_n(FX.pairs(t).select("article_id", "language"), 50, ["article_id"])


_ISSUE_FREE = """strpos(left(text, 500), '{{Infobox') = 0
  and (length(text) - length(replace(text, '*', ''))) <= 15"""


@register("seeded_sample", rsql(f"""
select article_id, language from pairs
where {_ISSUE_FREE}
order by md5(concat('42:', article_id)), article_id limit 100""", "", ("pairs",)))
def seeded_sample(t):
    p = FX.pairs(t)
    ok = ~F.left("text", F.lit(500)).contains("{{Infobox") & (T.count_occurrences(F.col("text"), "*") <= 15)
    return C.seeded_sample(p, 100, 42, "article_id", ok).select("article_id", "language")


@register("sample_without_replacement", rsql("""
select article_id, language from dataset where split = 'test'
order by md5(concat('3:', article_id)), article_id limit 1000""", "", ("dataset",)))
def sample_without_replacement(t):
    d = FX.dataset(t).filter(F.col("split") == "test")
    return C.sample_without_replacement(d, 1000, 3, "article_id").select("article_id", "language")


@register("three_way_split", rsql("select article_id, language, split from dataset", "", ("dataset",)))
def three_way_split(t):
    return FX.dataset(t).select("article_id", "language", "split")


@register("batch_assign", rsql("""
select article_id, language,
       cast(floor((row_number() over (partition by language order by doc_id) - 1) / 8) as bigint) as batch
from pairs""", "", ("pairs",)))
def batch_assign(t):
    return C.batch_assign(FX.pairs(t), 8, ["doc_id"], by=["language"]).select("article_id", "language", "batch")
