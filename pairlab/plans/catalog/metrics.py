"""Summary-quality metric queries over model outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import text as TX
from pairlab.operators import metrics as M
from pairlab.operators import profile as PR
from pairlab.plans import fixtures as FX
from pairlab.plans.catalog import sqlbits as Q
from pairlab.plans.catalog.base import register, rsql

GKEYS = ["article_id", "language", "model"]
WORD = "[\\p{L}\\p{N}]+"


def rouge_sql(src: str, keys: list[str], ns=(1, 2), gen="generated", ref="reference", pattern=WORD,
              lower=True, prefix="rouge") -> str:
    """Oracle ROUGE-N: n-gram counts per side, clipped overlap, P/R/F1."""
    k = ", ".join(keys)
    low = (lambda x: f"lower({x})") if lower else (lambda x: x)

    def grams(col, n):
        if n == 1:
            return f"unnest({col})"
        parts = " || ' ' || ".join(f"{col}[i + {j}]" for j in range(n))
        return f"unnest(list_transform(range(1, len({col}) - {n - 2}), lambda i: {parts}))"
    ctes = [f"toks as (select {k}, regexp_extract_all({low(gen)}, '{pattern}') as h, "
            f"regexp_extract_all({low(ref)}, '{pattern}') as r from {src})"]
    sel = [", ".join(f"t.{c}" for c in keys)]
    joins = []
    for n in ns:
        ctes += [f"hc{n} as (select {k}, g, count(*) as c from (select {k}, {grams('h', n)} as g from toks) x group by all)",
                 f"rc{n} as (select {k}, g, count(*) as c from (select {k}, {grams('r', n)} as g from toks) x group by all)",
                 f"ov{n} as (select {k}, sum(least(a.c, b.c)) as ov from hc{n} a join rc{n} b using ({k}, g) group by all)",
                 f"nh{n} as (select {k}, sum(c) as nh from hc{n} group by all)",
                 f"nr{n} as (select {k}, sum(c) as nr from rc{n} group by all)",
                 f"s{n} as (select {', '.join(f't.{c}' for c in keys)}, "
                 f"case when coalesce(nh, 0) > 0 then coalesce(ov, 0) / nh else 0.0 end as p, "
                 f"case when coalesce(nr, 0) > 0 and coalesce(nh, 0) > 0 then coalesce(ov, 0) / nr else 0.0 end as r "
                 f"from toks t left join ov{n} using ({k}) left join nh{n} using ({k}) left join nr{n} using ({k}))"]
        sel.append(f"s{n}.p as {prefix}{n}_p, s{n}.r as {prefix}{n}_r, "
                   f"case when s{n}.p + s{n}.r > 0 then 2.0 * s{n}.p * s{n}.r / (s{n}.p + s{n}.r) else 0.0 end "
                   f"as {prefix}{n}_f")
        joins.append(f"join s{n} using ({k})")
    return ("with " + ",\n".join(ctes) + f"\nselect {', '.join(sel)} from toks t " + " ".join(joins))


def rouge_doubles(ns=(1, 2), prefix="rouge") -> str:
    return ",".join(f"{prefix}{n}_{x}" for n in ns for x in "prf")


def _scores(t):
    return M.rouge_scores(FX.generations(t), GKEYS, (1, 2))


def _scores3(t):
    """ROUGE-1/2 P/R/F plus ROUGE-L F per pair (the reference's three metrics)."""
    return M.rouge_all(FX.generations(t), GKEYS).drop("rougeL_p", "rougeL_r")


M3 = ["rouge1_f", "rouge2_f", "rougeL_f"]


@register("rouge_n", rsql(rouge_sql("generations", GKEYS), rouge_doubles(), ("generations",)))
def rouge_n(t):
    return _scores(t)


def lcs_sql(src: str, keys: list[str], gen: str = "generated", ref: str = "reference", pattern: str = WORD) -> str:
    """Oracle LCS by a recursive CTE over the hypothesis tokens.

    Row recurrence: new[j] = max(old[j], old[m(j) - 1] + 1) where m(j) is the
    last reference position <= j holding the current hypothesis token (rows
    are non-decreasing, so the last match dominates earlier ones).
    """
    k = ", ".join(keys)
    on = " and ".join(f"d.{c} = t.{c}" for c in keys)
    return f"""with recursive toks as (
  select {k}, regexp_extract_all(lower({gen}), '{pattern}') as h,
         regexp_extract_all(lower({ref}), '{pattern}') as r from {src}),
dp({k}, i, row) as (
  select {k}, 0, list_transform(range(0, len(r) + 1), lambda x: 0) from toks
  union all
  select {k}, i + 1,
         list_concat([0], list_transform(range(1, len(r) + 1),
           lambda j: greatest(row[j + 1], coalesce(row[list_max(list_filter(P, lambda p: p <= j))] + 1, 0))))
  from (select {', '.join('d.' + c for c in keys)}, d.i, d.row, t.r,
               list_filter(range(1, len(t.r) + 1), lambda p: t.r[p] = t.h[d.i + 1]) as P
        from dp d join toks t on {on} where d.i < len(t.h)) x),
lcs as (
  select {', '.join('d.' + c for c in keys)}, d.row[len(d.row)] as hit, len(t.h) as nh, len(t.r) as nr
  from dp d join toks t on {on} where d.i = len(t.h)),
pr as (
  select {k}, case when nh = 0 or nr = 0 then 0.0 else hit / nh end as p,
         case when nh = 0 or nr = 0 then 0.0 else hit / nr end as r from lcs)
select {k}, p as rougeL_p, r as rougeL_r, case when p + r > 0 then 2.0 * p * r / (p + r) else 0.0 end as rougeL_f
from pr"""


@register("rouge_l", rsql(lcs_sql("generations", GKEYS), "rougeL_p,rougeL_r,rougeL_f", ("generations",)))
def rouge_l(t):
    """LCS-based P/R/F1 per pair (bit-parallel LCS on whole texts)."""
    return M.rouge_l(FX.generations(t), GKEYS)


def lcs_sum_sql(src: str, keys: list[str], gen: str = "generated", ref: str = "reference",
                pattern: str = WORD) -> str:
    """Oracle ROUGE-Lsum: per (reference sentence, generated sentence) the LCS
    table by a recursive CTE, one LCS backtracked exactly like the Python
    helper (take a match, else move along the generated sentence when the
    value is unchanged, else along the reference), union of the matched
    reference positions over generated sentences, summed over reference
    sentences."""
    k = ", ".join(keys)

    def cols(alias):
        return ", ".join(f"{alias}.{c}" for c in keys)

    def sents(x):
        return (f"list_filter(list_transform(string_split(replace({x}, '. ', chr(10)), chr(10)), "
                f"lambda s: regexp_extract_all(lower(s), '{pattern}')), lambda t: len(t) > 0)")
    same = " and ".join(f"p.{c} = b.{c}" for c in keys)
    return f"""with recursive s as (
  select {k}, {sents(gen)} as hs, {sents(ref)} as rs from {src}),
tot as (
  select {k}, coalesce(list_sum(list_transform(hs, lambda t: len(t))), 0) as nh,
         coalesce(list_sum(list_transform(rs, lambda t: len(t))), 0) as nr from s),
combos as (
  select {k}, ri, rt, hi, ht
  from (select {k}, unnest(rs) as rt, unnest(range(1, len(rs) + 1)) as ri, hs from s) a,
       lateral (select unnest(a.hs) as ht, unnest(range(1, len(a.hs) + 1)) as hi) b),
dp({k}, ri, hi, j, row) as (
  select {k}, ri, hi, 0, list_transform(range(0, len(rt) + 1), lambda x: 0) from combos
  union all
  select {k}, ri, hi, j + 1,
         list_concat([0], list_transform(range(1, len(rt) + 1),
           lambda i: greatest(row[i + 1], coalesce(row[list_max(list_filter(P, lambda p: p <= i))] + 1, 0))))
  from (select {cols('d')}, d.ri, d.hi, d.j, d.row, c.rt,
               list_filter(range(1, len(c.rt) + 1), lambda p: c.rt[p] = c.ht[d.j + 1]) as P
        from dp d join combos c using ({k}, ri, hi) where d.j < len(c.ht)) x),
bt({k}, ri, hi, i, j, cur, pos) as (
  select {cols('c')}, c.ri, c.hi, len(c.rt), len(c.ht), d.row[len(c.rt) + 1], cast(null as bigint)
  from combos c join dp d using ({k}, ri, hi) where d.j = len(c.ht)
  union all
  select {cols('b')}, b.ri, b.hi,
         case when c.rt[b.i] = c.ht[b.j] then b.i - 1 when p.row[b.i + 1] = b.cur then b.i else b.i - 1 end,
         case when c.rt[b.i] = c.ht[b.j] then b.j - 1 when p.row[b.i + 1] = b.cur then b.j - 1 else b.j end,
         case when c.rt[b.i] = c.ht[b.j] then b.cur - 1 else b.cur end,
         case when c.rt[b.i] = c.ht[b.j] then b.i - 1 end
  from bt b join combos c using ({k}, ri, hi)
       join dp p on {same} and p.ri = b.ri and p.hi = b.hi and p.j = b.j - 1
  where b.i > 0 and b.j > 0 and b.cur > 0),
hits as (
  select {k}, sum(n) as hit
  from (select {k}, ri, count(distinct pos) as n from bt where pos is not null group by all) u group by all),
pr as (
  select {cols('t')}, case when t.nh = 0 or t.nr = 0 then 0.0 else coalesce(h.hit, 0) / t.nh end as p,
         case when t.nh = 0 or t.nr = 0 then 0.0 else coalesce(h.hit, 0) / t.nr end as r
  from tot t left join hits h using ({k}))
select {k}, p as rougeLsum_p, r as rougeLsum_r,
       case when p + r > 0 then 2.0 * p * r / (p + r) else 0.0 end as rougeLsum_f
from pr"""


@register("rouge_lsum", rsql(lcs_sum_sql("generations", GKEYS), "rougeLsum_p,rougeLsum_r,rougeLsum_f",
                             ("generations",)))
def rouge_lsum(t):
    """Summary-level union LCS per pair (Lin 2004, 3.2)."""
    return M.rouge_lsum(FX.generations(t), GKEYS)


TP_KEYS = ["conv_id", "turn"]





@register("rouge_segmented", rsql(rouge_sql("generations", GKEYS, pattern="\\S", lower=False, prefix="char_rouge"),
                                  rouge_doubles(prefix="char_rouge"), ("generations",)))
def rouge_segmented(t):
    """ROUGE for scripts without spaces: every non-space character is a token."""
    return M.rouge_scores(FX.generations(t), GKEYS, (1, 2), tokenizer="char", prefix="char_rouge")


_MEAN_SQL = f"""
select model, coalesce(avg(rouge1_f), 0.0) as rouge1_f, coalesce(avg(rouge2_f), 0.0) as rouge2_f, count(*) as n_rows
from ({rouge_sql('generations', GKEYS)}) s group by model"""


_MEAN3_SQL = f"""
select m.model, m.rouge1_f, m.rouge2_f, coalesce(l.rougeL_f, 0.0) as rougeL_f, m.n_rows
from ({_MEAN_SQL}) m
join (select model, avg(rougeL_f) as rougeL_f from ({lcs_sql('generations', GKEYS)}) x group by model) l
  using (model)"""


@register("mean_rouge", rsql(_MEAN3_SQL, "rouge1_f,rouge2_f,rougeL_f", ("generations",)))
def mean_rouge(t):
    return M.mean_rouge(_scores3(t), metrics=M3)


def _improvement_sql() -> str:
    cols = []
    inner = []
    for m in M3:
        inner += [f"max({m}) filter (where model = 'base') as base_{m}",
                  f"max({m}) filter (where model = 'finetuned') as finetuned_{m}"]
        cols += [f"base_{m}", f"finetuned_{m}",
                 f"case when base_{m} > 0 then (finetuned_{m} - base_{m}) / base_{m} * 100 else 0.0 end "
                 f"as improvement_{m}"]
    return f"select {', '.join(cols)} from (select {', '.join(inner)} from ({_MEAN3_SQL}) m) w"


@register("rouge_improvement", rsql(_improvement_sql(),
                                    ",".join(f"{p}_{m}" for m in M3 for p in ("base", "finetuned", "improvement")),
                                    ("generations",)))
def rouge_improvement(t):
    return M.rouge_improvement(M.mean_rouge(_scores3(t), metrics=M3), metrics=M3)


@register("best_worst_examples", rsql(f"""
select e.*, g.reference, g.generated from (
select * from (
  select article_id, language, model, rouge1_f, 'worst' as kind,
         row_number() over (partition by model order by rouge1_f asc, article_id, language) as position
  from ({rouge_sql('generations', GKEYS, ns=(1,))}) s) where position <= 5
union all
select article_id, language, model, rouge1_f, kind, count(*) over (partition by model) + 1 - position as position
from (
  select article_id, language, model, rouge1_f, 'best' as kind,
         row_number() over (partition by model order by rouge1_f desc, article_id, language) as position
  from ({rouge_sql('generations', GKEYS, ns=(1,))}) s) where position <= 5
) e join generations g using (article_id, language, model)""", "rouge1_f", ("generations",)))
def best_worst_examples(t):
    s = M.rouge_scores(FX.generations(t), GKEYS, (1,)).select(*GKEYS, "rouge1_f")
    picked = M.best_worst_examples(s, 5).select(*GKEYS, "rouge1_f", "kind", F.col("position").cast("bigint"))
    return picked.join(FX.generations(t).select(*GKEYS, "reference", "generated"), GKEYS)


_PER_EX_SQL = f"""
select s.article_id, s.language, s.model, {Q.words('g.generated')} as generated_words,
       {Q.words('g.reference')} as reference_words, s.rouge1_f, s.rouge2_f
from ({rouge_sql('generations', GKEYS)}) s join generations g using (article_id, language, model)"""


@register("per_example_metrics", rsql(_PER_EX_SQL, "rouge1_f,rouge2_f", ("generations",)))
def per_example_metrics(t):
    g = FX.generations(t)
    lens = [TX.word_len("generated").alias("generated_words"), TX.word_len("reference").alias("reference_words")]
    return M.rouge_all(g, GKEYS, lcs=False, carry=lens).select(*GKEYS, "generated_words", "reference_words", "rouge1_f", "rouge2_f")


def _len_sql(src: str) -> str:
    return f"""
select model, avg(gw) as avg_generated_words, avg(rw) as avg_reference_words,
       cast(median(gw) as double) as median_generated_words, cast(median(rw) as double) as median_reference_words,
       avg(gw) / avg(rw) as length_ratio,
       case when var_pop(gw) > 0 and var_pop(rw) > 0 and count(*) > 1 then corr(gw, rw) end as length_correlation
from (select model, {Q.words('generated')} as gw, {Q.words('reference')} as rw from {src}) x
group by model"""


_LEN_D = ("avg_generated_words,avg_reference_words,median_generated_words,median_reference_words,"
          "length_ratio,length_correlation")


@register("summary_length_metrics", rsql(_len_sql("generations"), _LEN_D, ("generations",)))
def summary_length_metrics(t):
    return PR.summary_length_metrics(FX.generations(t))


@register("gen_len", rsql(f"""
select model, avg({Q.words('generated')}) as gen_len from generations group by model""", "gen_len",
                          ("generations",)))
def gen_len(t):
    return PR.gen_len(FX.generations(t))





@register("melt_metrics", rsql(f"""
select model, metric, score from ({_MEAN3_SQL}) m
unpivot (score for metric in (rouge1_f, rouge2_f, rougeL_f))""", "score", ("generations",)))
def melt_metrics(t):
    return M.melt_metrics(M.mean_rouge(_scores3(t), metrics=M3).drop("n_rows"), ["model"], M3)


@register("side_by_side", rsql("""
select article_id, language,
       max(generated) filter (where model = 'base') as base,
       max(generated) filter (where model = 'finetuned') as finetuned,
       max(case when length(text) > 500 then concat(left(text, 500), '...') else text end) as source
from generations group by article_id, language""", "", ("generations",)))
def side_by_side(t):
    g = FX.generations(t)
    sbs = M.side_by_side(g, ["article_id", "language"], ["base", "finetuned"])
    src = FX.pairs(t).select("article_id", "language", TX.truncate_ellipsis("text", 500).alias("source"))
    return sbs.join(src, ["article_id", "language"])


@register("round_metrics", rsql(f"""
select model, round(rouge1_f * 100, 2) as rouge1_f, round(rouge2_f * 100, 2) as rouge2_f,
       round(rougeL_f * 100, 2) as rougeL_f
from ({_MEAN3_SQL}) m""", "rouge1_f,rouge2_f,rougeL_f", ("generations",)))
def round_metrics(t):
    return M.round_metrics(M.mean_rouge(_scores3(t), metrics=M3).select("model", *M3), M3)


@register("union_model_metrics", rsql(f"""
select model, avg(rouge1_f) as rouge1_f, count(*) as n_rows
from ({rouge_sql('generations', GKEYS, ns=(1,))}) s group by model""", "rouge1_f", ("generations",)))
def union_model_metrics(t):
    s = M.rouge_scores(FX.generations(t), GKEYS, (1,))
    # the models' rows are scored and grouped once, then appended model by model
    means = s.groupBy("model").agg(F.avg("rouge1_f").alias("rouge1_f"), F.count(F.lit(1)).alias("n_rows"))
    return M.union_model_metrics(*(means.filter(F.col("model") == m) for m in ("base", "finetuned")))


@register("metric_grid_improvement", rsql(f"""
with s0 as ({rouge_sql('generations', GKEYS)}),
lc as ({lcs_sql('generations', GKEYS)}),
s as (select s0.*, lc.rougeL_f from s0 join lc using (article_id, language, model)),
grid as (
  select d.language as tuned_lang, d.split as test_lang,
         case when s.model = 'base' then 'base_model' else 'finetuned_model' end as variant,
         m.metric, case when m.metric = 'rouge1' then avg(s.rouge1_f) when m.metric = 'rouge2' then avg(s.rouge2_f)
                        else avg(s.rougeL_f) end as score
  from s join dataset d using (article_id, language), (values ('rouge1'), ('rouge2'), ('rougeL')) m(metric)
  group by d.language, d.split, s.model = 'base', m.metric),
w as (select tuned_lang, test_lang, metric,
             max(score) filter (where variant = 'base_model') as b,
             max(score) filter (where variant = 'finetuned_model') as f
      from grid group by all)
select tuned_lang, test_lang, metric,
       case when coalesce(b, 1.0) = 0 then null
            else (coalesce(f, 0.0) - coalesce(b, 0.0)) / coalesce(b, 1.0) * 100 end as improvement
from w""", "improvement", ("generations", "dataset")))
def metric_grid_improvement(t):
    s = _scores3(t)
    d = FX.dataset(t).select("article_id", "language", "split")
    j = s.join(d, ["article_id", "language"])
    variant = F.when(F.col("model") == "base", "base_model").otherwise("finetuned_model")
    grid = (j.groupBy(F.col("language").alias("tuned_lang"), F.col("split").alias("test_lang"),
                      variant.alias("variant"))
            .agg(F.avg("rouge1_f").alias("rouge1"), F.avg("rouge2_f").alias("rouge2"), F.avg("rougeL_f").alias("rougeL"))
            .unpivot(["tuned_lang", "test_lang", "variant"], ["rouge1", "rouge2", "rougeL"], "metric", "score"))
    return M.metric_grid_improvement(grid)


@register("embedding_match_score", rsql("""
with v as (select pair_id, side, pos, cast(embedding as double[]) as e from token_vectors),
c as (select a.pair_id, a.pos, max(list_cosine_similarity(a.e, b.e)) as m
      from v a join v b on a.pair_id = b.pair_id and a.side = 'cand' and b.side = 'ref' group by all),
r as (select b.pair_id, b.pos, max(list_cosine_similarity(a.e, b.e)) as m
      from v a join v b on a.pair_id = b.pair_id and a.side = 'cand' and b.side = 'ref' group by all),
pr as (select pair_id, p, rr from (select pair_id, avg(m) as p from c group by all) x
       join (select pair_id, avg(m) as rr from r group by all) y using (pair_id))
select i.pair_id, coalesce(p, 0.0) as emb_p, coalesce(rr, 0.0) as emb_r,
       case when p + rr > 0 then 2.0 * p * rr / (p + rr) else 0.0 end as emb_f
from (select distinct pair_id from v) i left join pr on i.pair_id = pr.pair_id""", "emb_p,emb_r,emb_f", ("token_vectors",)))
def embedding_match_score(t):
    return M.embedding_match_score(FX.token_vectors(t))


def _prf_table_sql() -> str:
    n = rouge_sql("turn_pairs", TP_KEYS, gen="summary", ref="text")
    lcs = lcs_sql("turn_pairs", TP_KEYS, gen="summary", ref="text")
    lsum = lcs_sum_sql("turn_pairs", TP_KEYS, gen="summary", ref="text")
    return f"""select n.*, l.rougeL_f, s.rougeLsum_f
from ({n}) n join ({lcs}) l using (conv_id, turn) join ({lsum}) s using (conv_id, turn)"""


@register("rouge_prf_table", rsql(_prf_table_sql(), rouge_doubles() + ",rougeL_f,rougeLsum_f", ("turn_pairs",)))
def rouge_prf_table(t):
    """P/R/F for ROUGE-1/2 and F for ROUGE-L / ROUGE-Lsum per turn pair."""
    return M.rouge_prf_table(FX.turn_pairs(t), TP_KEYS, with_lcs=True, generated="summary", reference="text")


def report_sql(src: str) -> str:
    return f"""
select m.*, lm.rougeL_f, ls.rougeLsum_f, l.* exclude (model)
from (select model, {', '.join(f'coalesce(avg({c}), 0.0) as {c}' for c in rouge_doubles().split(','))}
      from ({rouge_sql(src, GKEYS)}) s group by model) m join ({_len_sql(src)}) l using (model)
join (select model, coalesce(avg(rougeL_f), 0.0) as rougeL_f from ({lcs_sql(src, GKEYS)}) x group by model) lm
  using (model)
join (select model, coalesce(avg(rougeLsum_f), 0.0) as rougeLsum_f from ({lcs_sum_sql(src, GKEYS)}) x group by model) ls
  using (model)"""


_EMB_SQL = """
select model, avg(coalesce(emb_p, 0.0)) as emb_p, avg(coalesce(emb_r, 0.0)) as emb_r, avg(coalesce(emb_f, 0.0)) as emb_f
from generations left join
  (select article_id, language, model, p as emb_p, r as emb_r, case when p + r > 0 then 2.0 * p * r / (p + r) else 0.0 end as emb_f
   from (select article_id, language, model, avg(m) as p from (
           select a.article_id, a.language, a.model, a.pos, max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) as m
           from generation_vectors a join generation_vectors b using (article_id, language, model)
           where a.side = 'cand' and b.side = 'ref' group by all) x group by all) x
   join (select article_id, language, model, avg(m) as r from (
           select a.article_id, a.language, a.model, b.pos, max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) as m
           from generation_vectors a join generation_vectors b using (article_id, language, model)
           where a.side = 'cand' and b.side = 'ref' group by all) y group by all) y using (article_id, language, model)) s
  using (article_id, language, model) group by model"""


@register("evaluation_report", rsql(f"select r.*, e.* exclude (model) from ({report_sql('generations')}) r join ({_EMB_SQL}) e using (model)",
                                    rouge_doubles() + ",rougeL_f,rougeLsum_f,emb_p,emb_r,emb_f," + _LEN_D, ("generations", "generation_vectors")))
def evaluation_report(t):
    """One row per model: mean ROUGE-1/2 (P/R/F), L and Lsum (F), the length metrics and the embedding match P/R/F."""
    from pairlab.plans.flagships import evaluation_report as er
    return er(FX.generations(t), with_lcs=True, vectors=FX.generation_vectors(t))
