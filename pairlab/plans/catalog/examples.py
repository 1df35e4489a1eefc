"""Training-example queries: vocabulary, ids, labels, masks, buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import arrays as A
from pairlab.functions import prompts as P
from pairlab.functions.tokenizers import tokenizer_udf
from pairlab.operators import examples as X
from pairlab.plans import fixtures as FX
from pairlab.plans.catalog.base import register, rsql

PAT = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"
KEYS = ["article_id", "language"]

VOCAB_SQL = f"""vocab as (
  select token, cast(row_number() over (order by n desc, token) + 1 as integer) as id, n
  from (select token, count(*) as n
        from (select unnest(regexp_extract_all(text, '{PAT}')) as token from pairs) a group by token) c)"""


def ids_sql(name: str, col: str, max_len: int, src: str = "pairs") -> str:
    """CTE ``name``(article_id, language, ids INT[]) tokenising ``col``."""
    return f"""{name} as (
  select article_id, language, list(coalesce(v.id, 1) order by pos) as ids
  from (select article_id, language, unnest(tk) as token, unnest(range(0, len(tk))) as pos
        from (select article_id, language, regexp_extract_all({col}, '{PAT}') as tk from {src}) s) t
  left join vocab v using (token) where pos < {max_len} group by article_id, language)"""


def _vocab(t):
    return X.build_vocab(FX.pairs(t), "text")


@register("build_vocab", rsql(f"with {VOCAB_SQL} select token, id, n from vocab", "", ("pairs",)))
def build_vocab(t):
    return _vocab(t)


@register("tokenize", rsql(f"""with {VOCAB_SQL}, {ids_sql('ids', 'text', 512)}
select article_id, language, array_to_string(ids, ',') as input_ids from ids""", "", ("pairs",)))
def tokenize(t):
    ids = X.tokenize(FX.pairs(t), KEYS, "text", _vocab(t), 512)
    return ids.select(*KEYS, A.join_ints("input_ids").alias("input_ids"))


@register("attention_mask", rsql(f"""with {VOCAB_SQL}, {ids_sql('ids', 'text', 512)}
select article_id, language, array_to_string(list_transform(ids, lambda x: 1), ',') as attention_mask
from ids""", "", ("pairs",)))
def attention_mask(t):
    ids = X.tokenize(FX.pairs(t), KEYS, "text", _vocab(t), 512)
    return ids.select(*KEYS, A.join_ints(A.attention_mask("input_ids")).alias("attention_mask"))


_PROMPTED = f"""prompted as (
  select article_id, language, {P.sql_fill(P.INSTRUCTION_TEMPLATE, text='text')} as prompt,
         concat({P.sql_fill(P.INSTRUCTION_TEMPLATE, text='text')}, summary) as full_text
  from pairs)"""


@register("mask_prompt_labels", rsql(f"""with {VOCAB_SQL}, {_PROMPTED}, {ids_sql('ids', 'full_text', 640, 'prompted')},
pl as (select article_id, language, least(len(regexp_extract_all(prompt, '{PAT}')), 512) as p from prompted)
select article_id, language, array_to_string(ids, ',') as input_ids,
       array_to_string(list_transform(ids, lambda x: 1), ',') as attention_mask,
       array_to_string(list_concat(list_transform(range(0, least(p, len(ids))), lambda i: -100),
                                   ids[p + 1:]), ',') as labels
from ids join pl using (article_id, language)""", "", ("pairs",)))
def mask_prompt_labels(t):
    p = FX.pairs(t).withColumn("prompt", P.instruction_prompt("text"))
    p = p.withColumn("full_text", F.concat("prompt", "summary"))
    m = X.mask_prompt_labels(p, KEYS, "prompt", "full_text", _vocab(t), 512, 128)
    return m.select(*KEYS, A.join_ints("input_ids").alias("input_ids"),
                    A.join_ints("attention_mask").alias("attention_mask"), A.join_ints("labels").alias("labels"))


_PAD_SQL = f"""padded as (
  select article_id, language,
         list_transform(list_concat(ids, list_transform(range(0, greatest(128 - len(ids), 0)), lambda i: 0))[1:128],
                        lambda x: case when x = 0 then -100 else x end) as labels
  from sids)"""


@register("pad_labels", rsql(f"""with {VOCAB_SQL}, {ids_sql('sids', 'summary', 128)}, {_PAD_SQL}
select article_id, language, array_to_string(labels, ',') as labels from padded""", "", ("pairs",)))
def pad_labels(t):
    ids = X.tokenize(FX.pairs(t), KEYS, "summary", _vocab(t), 128, out="ids")
    return ids.select(*KEYS, A.join_ints(A.pad_labels("ids", 128, X.PAD_ID)).alias("labels"))


@register("unmask_labels", rsql(f"""with {VOCAB_SQL}, {ids_sql('sids', 'summary', 128)}, {_PAD_SQL}
select article_id, language, coalesce(string_agg(v.token, ' ' order by pos), '') as text
from (select article_id, language, unnest(list_transform(labels, lambda x: case when x = -100 then 0 else x end)) as id,
             unnest(range(0, len(labels))) as pos from padded) u
left join vocab v using (id) where u.id >= 2
group by article_id, language""", "", ("pairs",)))
def unmask_labels(t):
    vocab = _vocab(t)
    ids = X.tokenize(FX.pairs(t), KEYS, "summary", vocab, 128, out="ids")
    lab = ids.select(*KEYS, A.unmask_labels(A.pad_labels("ids", 128, X.PAD_ID), X.PAD_ID).alias("labels"))
    return X.decode(lab, KEYS, "labels", vocab, out="text")


@register("length_buckets", rsql(f"""
select batch, count(*) as rows, cast(ceil(max(len) / 8) * 8 as bigint) as padded_len,
       cast(count(*) * ceil(max(len) / 8) * 8 - sum(len) as bigint) as padding_waste
from (select cast(floor((row_number() over (order by len, article_id, language) - 1) / 16) as bigint) as batch, len
      from (select article_id, language, cast(len(regexp_extract_all(text, '{PAT}')) as bigint) as len
            from pairs) a) b
group by batch""", "", ("pairs",)))
def length_buckets(t):
    from pairlab.functions import text as TX
    p = FX.pairs(t).select("article_id", "language", TX.token_len("text").alias("len"))
    p = p.withColumn("_k", F.concat_ws("\n", "article_id", "language"))
    return X.length_buckets(p, "len", 16, 8, key="_k")


_split_words = tokenizer_udf(lambda s: s.split())


@register("tokenizer_udf", rsql("""
select doc_id, cast(len(regexp_extract_all(text, '\\S+')) as bigint) as n_tokens from documents"""))
def tokenizer_udf_query(t):
    """A user tokenizer (here Python's str.split) through the Arrow UDF slot."""
    return t.documents.select("doc_id", F.size(_split_words(F.col("text"))).cast("bigint").alias("n_tokens"))
