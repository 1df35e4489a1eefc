"""Scalar text functions over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import prompts as P
from pairlab.functions import text as T
from pairlab.plans import fixtures as FX
from pairlab.plans.catalog.base import register, rsql

INSTR = P.sql_fill(P.INSTRUCTION_TEMPLATE, text="text")


@register("char_len", rsql("select doc_id, cast(length(text) as bigint) as char_len from documents"))
def char_len(t):
    return t.documents.select("doc_id", T.char_len("text").alias("char_len"))


@register("word_len", rsql(
    "select doc_id, cast(len(regexp_extract_all(text, '\\S+')) as bigint) as word_len from documents"))
def word_len(t):
    return t.documents.select("doc_id", T.word_len("text").alias("word_len"))


@register("sentence_count", rsql("""
select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[.!?]+'),
                               lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g') <> '')) as bigint)
       as sentence_count
from documents"""))
def sentence_count(t):
    return t.documents.select("doc_id", T.sentence_count("text").alias("sentence_count"))


@register("token_len", rsql("""
select doc_id, cast(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) as bigint) as token_len
from documents"""))
def token_len(t):
    return t.documents.select("doc_id", T.token_len("text", "wordpunct").alias("token_len"))


@register("compression_ratio", rsql("""
select article_id, language, model,
       case when length(generated) = 0 then cast('inf' as double)
            else length(text) / length(generated) end as compression_ratio
from generations""", "compression_ratio", ("generations",)))
def compression_ratio(t):
    g = FX.generations(t)
    return g.select("article_id", "language", "model",
                    T.compression_ratio(T.char_len("text"), T.char_len("generated")).alias("compression_ratio"))


@register("first_line", rsql("select doc_id, split_part(text, chr(10), 1) as first_line from documents"))
def first_line(t):
    return t.documents.select("doc_id", T.first_line("text").alias("first_line"))


@register("after_first_line", rsql("""
select doc_id, case when strpos(text, chr(10)) = 0 then ''
                    else substr(text, strpos(text, chr(10)) + 1) end as after_first_line
from documents"""))
def after_first_line(t):
    return t.documents.select("doc_id", T.after_first_line("text").alias("after_first_line"))


@register("split_first_line", rsql("""
select doc_id, split_part(text, chr(10), 1) as before,
       case when strpos(text, chr(10)) = 0 then null else substr(text, strpos(text, chr(10)) + 1) end as after
from documents"""))
def split_first_line(t):
    return t.documents.select("doc_id", T.split_first_line("text").alias("s")).select("doc_id", "s.before", "s.after")


@register("truncate_ellipsis", rsql("""
select doc_id, case when length(text) > 150 then concat(left(text, 150), '...') else text end as truncated
from documents"""))
def truncate_ellipsis(t):
    return t.documents.select("doc_id", T.truncate_ellipsis("text", 150).alias("truncated"))


@register("truncate_always_ellipsis", rsql(
    "select doc_id, concat(left(text, 300), '...') as truncated from documents"))
def truncate_always_ellipsis(t):
    return t.documents.select("doc_id", T.truncate_always_ellipsis("text", 300).alias("truncated"))


@register("strip_prompt", rsql(f"""
select article_id, language,
       regexp_replace(substr(concat(p, ' ', summary, chr(10)), length(p) + 1), '^\\s+|\\s+$', '', 'g') as response
from (select article_id, language, summary,
             {INSTR} as p
      from pairs) x""", "", ("pairs",)))
def strip_prompt(t):
    p = FX.pairs(t).withColumn("p", P.instruction_prompt("text"))
    full = F.concat(F.col("p"), F.lit(" "), F.col("summary"), F.lit("\n"))
    return p.select("article_id", "language", T.strip_prompt(full, "p").alias("response"))


@register("response_after_marker", rsql(f"""
select article_id, language,
       regexp_replace(split_part(concat(p, summary), '### Response:',
                                 len(string_split(concat(p, summary), '### Response:'))),
                      '^\\s+|\\s+$', '', 'g') as response
from (select article_id, language, summary,
             {INSTR} as p
      from pairs) x
union all
select cast(doc_id as varchar) as article_id, lang as language,
       regexp_replace(text, '^\\s+|\\s+$', '', 'g') as response
from documents""", "", ("pairs",)))
def response_after_marker(t):
    p = FX.pairs(t).withColumn("p", P.instruction_prompt("text"))
    a = p.select("article_id", "language",
                 T.response_after_marker(F.concat("p", "summary")).alias("response"))
    b = t.documents.select(F.col("doc_id").cast("string").alias("article_id"), F.col("lang").alias("language"),
                           T.response_after_marker("text").alias("response"))
    return a.unionByName(b)


@register("remove_repetitions", rsql("""
select doc_id,
       case when len(parts) <= 1 then text
            else array_to_string(list_filter(list_filter(parts, lambda s: s <> ''),
                     lambda s, i: list_position(list_filter(parts, lambda z: z <> ''), s) = i), ' ')
       end as cleaned
from (select doc_id, text,
             string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as parts
      from documents) x"""))
def remove_repetitions(t):
    return t.documents.select("doc_id", T.remove_repetitions("text").alias("cleaned"))


@register("sentence_distinct", rsql("""
select doc_id,
       cast(len(list_filter(list_filter(parts, lambda s: s <> ''),
                lambda s, i: list_position(list_filter(parts, lambda z: z <> ''), s) = i)) as bigint) as n_distinct,
       cast(len(list_filter(parts, lambda s: s <> '')) as bigint) as n_sentences
from (select doc_id,
             string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as parts
      from documents) x"""))
def sentence_distinct(t):
    parts = T.sentences("text")
    return t.documents.select("doc_id", F.size(T.sentence_distinct(parts)).cast("bigint").alias("n_distinct"),
                              F.size(F.filter(parts, lambda s: s != "")).cast("bigint").alias("n_sentences"))


@register("sentence_lines", rsql("select doc_id, replace(text, '. ', chr(10)) as lines from documents"))
def sentence_lines(t):
    return t.documents.select("doc_id", T.sentence_lines("text").alias("lines"))


@register("article_url", rsql("""
select doc_id, concat('https://', lang, '.example.org/wiki/', replace(split_part(text, chr(10), 1), ' ', '_')) as url
from documents"""))
def article_url(t):
    d = t.documents
    return d.select("doc_id", T.article_url(F.concat("lang", F.lit(".example.org")), T.first_line("text")).alias("url"))


@register("article_id", rsql(
    "select doc_id, substr(md5(split_part(text, chr(10), 1)), 1, 10) as article_id from documents"))
def article_id(t):
    return t.documents.select("doc_id", T.article_id(T.first_line("text")).alias("article_id"))


@register("article_id_collisions", rsql("""
select substr(md5(split_part(text, chr(10), 1)), 1, 4) as article_id,
       cast(count(distinct split_part(text, chr(10), 1)) as bigint) as n_titles
from documents group by 1 having count(distinct split_part(text, chr(10), 1)) > 1"""))
def article_id_collisions(t):
    """Collision audit of the id scheme (at 4 hex digits so collisions occur)."""
    d = t.documents.select(T.first_line("text").alias("title"))
    from pairlab.operators.corpus import article_id_audit
    return article_id_audit(d, width=4)


_ISSUES_SQL = """
select doc_id, concat_ws('|',
  case when strpos(left(text, 500), '{{Infobox') > 0 then 'Article starts with an infobox' end,
  case when f > 10 then concat('Article may be primarily filmography (indicators: ', cast(f as varchar), ')') end,
  case when s > 15 then concat('Article has many bullet points (', cast(s as varchar), ')') end) as issues
from (select doc_id, text,
        (length(lower(text)) - length(replace(lower(text), 'film)', ''))) // 5
      + (length(lower(text)) - length(replace(lower(text), 'cinema)', ''))) // 7
      + (length(lower(text)) - length(replace(lower(text), '* [[', ''))) // 4
      + (length(lower(text)) - length(replace(lower(text), 'filmographie', ''))) // 12
      + (length(lower(text)) - length(replace(lower(text), 'acteur', ''))) // 6
      + (length(lower(text)) - length(replace(lower(text), 'réalisateur', ''))) // 11 as f,
        length(text) - length(replace(text, '*', '')) as s
      from documents) x"""


@register("article_quality_issues", rsql(_ISSUES_SQL))
def article_quality_issues(t):
    return t.documents.select("doc_id", F.concat_ws("|", T.article_quality_issues("text")).alias("issues"))


@register("skip_problematic", rsql(f"""
select cast(count(*) filter (where issues <> '') as bigint) as skipped,
       cast(count(*) filter (where issues = '') as bigint) as kept
from ({_ISSUES_SQL}) y"""))
def skip_problematic(t):
    from pairlab.operators.corpus import skip_problematic as sp
    _, report = sp(t.documents)
    return report


@register("midtext_start_flag", rsql("""
select article_id, language, bool_or(strpos(left(generated, 50), 'ession') > 0) as midtext_start
from generations group by article_id, language""", "", ("generations",)))
def midtext_start_flag(t):
    g = FX.generations(t)
    return (g.groupBy("article_id", "language")
            .agg(F.bool_or(T.midtext_start_flag("generated", "ession")).alias("midtext_start")))


_COPY_SQL = """
(s <> '' and starts_with(t, left(s, 20))) or starts_with(s, left(t, 20))"""


@register("copied_lead_flag", rsql(f"""
select article_id, language, {_COPY_SQL} as copied_lead
from (select article_id, language,
             regexp_replace(lower(left(text, 100)), '^\\s+|\\s+$', '', 'g') as t,
             regexp_replace(lower(left(summary, 100)), '^\\s+|\\s+$', '', 'g') as s
      from pairs) x""", "", ("pairs",)))
def copied_lead_flag(t):
    p = FX.pairs(t)
    return p.select("article_id", "language", T.copied_lead_flag("text", "summary").alias("copied_lead"))


@register("prefix_text", rsql("select doc_id, concat('summarize: ', text) as prefixed from documents"))
def prefix_text(t):
    return t.documents.select("doc_id", T.prefix_text("text", "summarize: ").alias("prefixed"))


@register("non_empty_text", rsql("""
select article_id, language from articles where text is not null and regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''
""", "", ("articles",)))
def non_empty_text(t):
    from pairlab.operators.corpus import non_empty_text as ne
    return ne(FX.articles(t)).select("article_id", "language")
