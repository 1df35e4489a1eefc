"""Corpus-shaped tables derived from the driver tables.

The reference works on articles, summaries, model outputs, judge responses
and training logs; the driver provides documents, labels, conversations,
events and embeddings.  Each builder here derives one reference-shaped table
from whole driver tables (no row subsets), so every registered query grows
with the input.  ``SQL`` holds the same derivations as DuckDB/ANSI SQL for
the oracle (common table expressions, see ``with_fixtures``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.functions import text as T
from pairlab.operators import corpus as C
from pairlab.sources.tables import Tables

NL = "\n"


def _line(col: str, n: int):
    return F.split_part(F.col(col), F.lit(NL), F.lit(n))


def _doc_key(col: str):
    """Article key of a fixture row: the full md5 of the document id (128
    bits, so keys stay unique at any corpus size; the reference's 10-hex
    title id is the ``article_id`` operator, audited for collisions)."""
    return F.md5(F.col(col).cast("string"))


def articles(t: Tables) -> DataFrame:
    """(article_id, doc_id, language, title, text, url): one per document."""
    return sourced_articles(t).drop("source")


def sourced_articles(t: Tables) -> DataFrame:
    """``articles`` with the documents' ``source``."""
    d = t.documents
    title = T.first_line("text")
    return d.select("source", _doc_key("doc_id").alias("article_id"),
                    "doc_id", F.col("lang").alias("language"), title.alias("title"), "text",
                    T.article_url(F.concat(F.col("lang"), F.lit(".example.org")), title).alias("url"))


def summaries(t: Tables) -> DataFrame:
    """Generated summaries exist for the labelled documents.

    toxic -> refused (empty); low quality -> copied lead; else the second
    (and third) line of the text, multi-line when there is a third line.
    """
    d, l = t.documents, t.labels
    j = d.join(l, "doc_id", "inner")
    summary = (F.when(F.col("toxic") == 1, F.lit(""))
               .when(F.col("quality") == 0, F.left(F.col("text"), F.lit(200)))
               .when(_line("text", 3) != "", F.concat(_line("text", 2), F.lit(NL), _line("text", 3)))
               .when(_line("text", 2) != "", _line("text", 2))
               .otherwise(F.col("text")))
    return j.select(_doc_key("doc_id").alias("article_id"),
                    F.col("lang").alias("language"), summary.alias("summary"),
                    T.first_line("text").alias("title"))


def pairs(t: Tables) -> DataFrame:
    return C.join_article_summary(articles(t), summaries(t))


SPLIT = dict(train=0.8, val=0.1, test=0.1, seed=42)


def dataset(t: Tables) -> DataFrame:
    """Pairs with an exact seeded train/validation/test split per language."""
    return C.three_way_split(pairs(t), **SPLIT, by=["language"], key="article_id")


def generations(t: Tables) -> DataFrame:
    """Two model outputs per pair, with the reference summary.

    base = third line of the text ('' when there is none: the empty
    generation case); finetuned = first two lines of the text.
    """
    p = pairs(t)
    # one pass over the pairs: both model outputs come from the same row
    outs = F.array(
        F.struct(F.lit("base").alias("model"), _line("text", 3).alias("generated")),
        F.struct(F.lit("finetuned").alias("model"),
                 F.concat_ws(" ", _line("text", 1), _line("text", 2)).alias("generated")))
    return (p.select("article_id", "language", F.col("summary").alias("reference"), "text", "title",
                     F.explode(outs).alias("_o"))
            .select("article_id", "language", "_o.model", "_o.generated", "reference", "text", "title"))


def base_pages(t: Tables) -> DataFrame:
    """Category scan: a page per document, categories = sources.

    Titles repeat across sources (copies), so the same page name is seen
    in several categories; short junk pages are a non-article namespace.
    """
    d = t.documents
    return d.select(T.first_line("text").alias("name"), F.col("source").alias("category"),
                    F.substring(F.col("source"), 4, 10).cast("int").alias("category_rank"),
                    F.col("doc_id").alias("pos"),
                    F.when(F.col("n_chars") < 100, F.lit(1)).otherwise(F.lit(0)).alias("namespace"),
                    F.col("lang").alias("language"))


def lang_pages(t: Tables, lengths_only: bool = False) -> DataFrame:
    """(language, title, doc_id, text): first document per (language, title); with
    ``lengths_only`` the length ``n_text`` in the text's place, in one aggregation."""
    a = articles(t)
    if lengths_only:
        first = F.min_by(F.struct("doc_id", F.length("text").cast("bigint").alias("n_text")), "doc_id")
        return a.groupBy("language", "title").agg(first.alias("f")).select("language", "title", "f.doc_id", "f.n_text")
    first = a.groupBy("language", "title").agg(F.min("doc_id").alias("doc_id"))  # ids only: texts are fetched last
    return first.join(a.select("doc_id", "text"), "doc_id").select("language", "title", "doc_id", "text")


def base_links(t: Tables, base_lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """(base pages, language links).  One concept per source: its base page
    is the lowest-id base-language document; every other-language document
    of the source is a link (a later one overrides an earlier one)."""
    a = sourced_articles(t).select("source", "language", "title", "doc_id")
    base = (a.filter(F.col("language") == base_lang)
            .groupBy("source").agg(F.min_by("title", "doc_id").alias("page")))
    links = (a.filter(F.col("language") != base_lang).join(base, "source")
             .select("page", F.col("language").alias("lang"), F.col("title").alias("target"),
                     F.col("doc_id").alias("position")))
    return base, links


def judge_responses(t: Tables) -> DataFrame:
    """One judge response per document covering every parsing branch."""
    d = t.documents
    a = (1 + F.col("doc_id") % 5).cast("string")
    b = (1 + (F.col("doc_id") + 2) % 5).cast("string")
    b1 = (1 + (F.col("doc_id") + 1) % 5).cast("string")
    k = F.col("doc_id") % 6
    resp = (F.when(k == 0, F.concat(F.lit('{"score_a": '), a, F.lit(', "score_b": '), b,
                                    F.lit(', "explanation": "ok"}')))
            .when(k == 1, F.concat(F.lit('text before {"summary_a_score": '), a,
                                   F.lit(', "summary_b_score": 4} after')))
            .when(k == 2, F.concat(F.lit("Summary A: "), a, F.lit(" and summary B: "), b1))
            .when(k == 3, F.concat(F.lit("I give 12, "), a, F.lit(" then 5")))
            .when(k == 4, F.lit("no usable scores 9"))
            .otherwise(F.concat(F.lit('{"score_a": x, "score_b": 2} fallback 3 and '), a)))
    return d.select("doc_id", F.col("lang").alias("language"), resp.alias("response"))


def metric_log(t: Tables) -> DataFrame:
    """(run, metric, step, value): one evaluation series per user and event
    type, steps numbered in time order (two-level rank: a run holding a third
    of all events is still numbered by many tasks)."""
    from pairlab.operators.ranking import balanced_bucket, ranked
    e = t.events.select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"),
                        F.unix_micros("ts").alias("_t"), "event_id", "value")
    r = ranked(e, ["run", "metric"], [F.col("_t"), F.col("event_id")], balanced_bucket(e, "_t"), name="step")
    return r.select("run", "metric", "step", "value")


def generation_log(t: Tables) -> DataFrame:
    """Per-batch generation log: (language, batch_start, n_rows, seconds)."""
    e = t.events
    return (e.groupBy(F.col("event_type").alias("language"), F.date_trunc("hour", "ts").alias("batch_start"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("seconds")))


def turn_pairs(t: Tables) -> DataFrame:
    """user turn -> next assistant turn, as (conv_id, turn, text, summary)."""
    c = t.conversations
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("text"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("summary"))
    return u.join(a, ["conv_id", "turn"], "inner")


def token_vectors(t: Tables, pair_width: int = 20) -> DataFrame:
    """Token vectors of candidate/reference summaries.

    Consecutive vector ids form one summary pair (``pair_width`` vectors);
    the label's parity says whether a vector belongs to the candidate or to
    the reference side.  Pairs are bounded by construction, like real
    summaries (hundreds of tokens at most).
    """
    v = t.embeddings
    return v.select(F.floor(F.col("vec_id") / pair_width).cast("bigint").alias("pair_id"),
                    F.when(F.col("label") % 2 == 0, F.lit("cand")).otherwise(F.lit("ref")).alias("side"),
                    F.col("vec_id").alias("pos"), "embedding")


def generation_vectors(t: Tables) -> DataFrame:
    """Token vectors of the generations and their references: a word's vector is
    the row of ``embeddings`` that its characters pick (a stand-in for a model's
    embedding table, looked up by an equi-join)."""
    from pairlab.functions.tokenizers import tokens
    g = generations(t).select("article_id", "language", "model", F.explode(F.array(
        F.struct(F.lit("cand").alias("side"), F.col("generated").alias("t")), F.struct(F.lit("ref").alias("side"), F.col("reference").alias("t")))).alias("s"))
    w = g.select("article_id", "language", "model", "s.side", F.posexplode(tokens(F.col("s.t"), "word")).alias("pos", "w"))
    n = t.embeddings.agg(F.count(F.lit(1))).scalar()
    pick = (F.ascii("w") * 131 + F.length("w") * 17 + F.ascii(F.substring("w", -1, 1)) * 29) % n
    return (w.withColumn("vec_id", pick).join(t.embeddings.select("vec_id", "embedding"), "vec_id")
            .select("article_id", "language", "model", "side", "pos", "embedding"))


def build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return globals()[name](t)


# ------------------------------------------------------------------ SQL side

SQL = {
    "articles": """
select md5(cast(doc_id as varchar)) as article_id, doc_id, lang as language,
       split_part(text, chr(10), 1) as title, text,
       concat('https://', lang, '.example.org/wiki/', replace(split_part(text, chr(10), 1), ' ', '_')) as url
from documents""",
    "summaries": """
select md5(cast(d.doc_id as varchar)) as article_id, d.lang as language,
       case when l.toxic = 1 then ''
            when l.quality = 0 then left(d.text, 200)
            when split_part(d.text, chr(10), 3) <> ''
                 then concat(split_part(d.text, chr(10), 2), chr(10), split_part(d.text, chr(10), 3))
            when split_part(d.text, chr(10), 2) <> '' then split_part(d.text, chr(10), 2)
            else d.text end as summary,
       split_part(d.text, chr(10), 1) as title
from documents d join labels l on l.doc_id = d.doc_id""",
    "pairs": """
select a.article_id, a.doc_id, a.language, a.title, a.text, a.url, s.summary
from articles a join summaries s on a.article_id = s.article_id and a.language = s.language
where a.text is not null and regexp_replace(a.text, '^\\s+|\\s+$', '', 'g') <> ''
  and s.summary is not null and s.summary <> ''""",
    "dataset": f"""
select p.* exclude (r, n, nt),
       case when r <= nt then 'test' when r <= nt + ceil((n - nt) * cast({repr(0.1 / 0.9)} as double))
            then 'validation' else 'train' end as split
from (select *, ceil(n * cast({repr(0.1 / 1.0)} as double)) as nt
      from (select *, row_number() over (partition by language order by md5(concat('42:', article_id)), article_id) as r,
                   count(*) over (partition by language) as n
            from pairs) a) p""",
    "generations": """
select article_id, language, 'base' as model, split_part(text, chr(10), 3) as generated,
       summary as reference, text from pairs
union all
select article_id, language, 'finetuned' as model,
       concat_ws(' ', split_part(text, chr(10), 1), split_part(text, chr(10), 2)) as generated,
       summary as reference, text from pairs""",
    "base_pages": """
select split_part(text, chr(10), 1) as name, source as category,
       cast(substr(source, 4, 10) as integer) as category_rank, doc_id as pos,
       case when n_chars < 100 then 1 else 0 end as namespace, lang as language
from documents""",
    "judge_responses": """
select doc_id, lang as language,
       case doc_id % 6
         when 0 then concat('{"score_a": ', cast(1 + doc_id % 5 as varchar), ', "score_b": ',
                            cast(1 + (doc_id + 2) % 5 as varchar), ', "explanation": "ok"}')
         when 1 then concat('text before {"summary_a_score": ', cast(1 + doc_id % 5 as varchar),
                            ', "summary_b_score": 4} after')
         when 2 then concat('Summary A: ', cast(1 + doc_id % 5 as varchar), ' and summary B: ',
                            cast(1 + (doc_id + 1) % 5 as varchar))
         when 3 then concat('I give 12, ', cast(1 + doc_id % 5 as varchar), ' then 5')
         when 4 then 'no usable scores 9'
         else concat('{"score_a": x, "score_b": 2} fallback 3 and ', cast(1 + doc_id % 5 as varchar))
       end as response
from documents""",
    "metric_log": """
select user_id as run, event_type as metric,
       row_number() over (partition by user_id, event_type order by ts, event_id) as step, value
from events""",
    "generation_log": """
select event_type as language, date_trunc('hour', ts) as batch_start, count(*) as n_rows, sum(value) as seconds
from events group by all""",
    "turn_pairs": """
select u.conv_id, u.turn, u.text as text, a.text as summary
from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant'""",
    "token_vectors": """
select cast(floor(vec_id / 20) as bigint) as pair_id,
       case when label % 2 = 0 then 'cand' else 'ref' end as side, vec_id as pos, embedding
from embeddings""",
    "generation_vectors": """
select article_id, language, model, side, pos, embedding
from (select article_id, language, model, side, unnest(ws) as w, unnest(range(0, len(ws))) as pos
      from (select article_id, language, model, 'cand' as side, regexp_extract_all(lower(generated), '[\\p{L}\\p{N}]+') as ws from generations
            union all
            select article_id, language, model, 'ref', regexp_extract_all(lower(reference), '[\\p{L}\\p{N}]+') from generations) a) b
join embeddings on vec_id = (unicode(w) * 131 + length(w) * 17 + unicode(right(w, 1)) * 29) % (select count(*) from embeddings)""",
}

# dependency order for CTEs
_ORDER = ["articles", "summaries", "pairs", "dataset", "generations", "base_pages", "judge_responses",
          "metric_log", "generation_log", "turn_pairs", "token_vectors", "generation_vectors"]
_DEPS = {"pairs": ["articles", "summaries"], "generations": ["pairs"], "generation_vectors": ["generations"], "dataset": ["pairs"]}


def _closure(names):
    out = set()

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        out.add(n)
    for n in names:
        add(n)
    return [n for n in _ORDER if n in out]


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named fixtures (and their inputs)."""
    ctes = ",\n".join(f"{n} as ({SQL[n]})" for n in _closure(names))
    body = sql.lstrip()
    if body[:15].lower() == "with recursive ":
        return f"with recursive {ctes},\n{body[15:]}"
    if body[:5].lower() == "with ":  # merge the query's own CTEs after the fixtures
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{sql}"
