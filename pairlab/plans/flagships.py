"""Flagship compositions of the operators (the reference's end-to-end jobs)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.operators import profile as PR
from pairlab.session import cut_lineage


def profile_corpus(dataset: DataFrame, by=("language", "split"), tokenizer: str = "wordpunct",
                   approx: bool = False) -> DataFrame:
    """Length statistics, token percentiles and copied-lead ratio per (language,
    split) from one scan and one aggregation (the exchange carries partial
    buffers only), with the lengths recommended for training on each row."""
    stats = PR.length_stats(dataset, by, tokenizer=tokenizer, approx=approx, with_copy_ratio=True,
                            more_percentiles=(0.75, 0.9, 0.97))
    return PR.with_recommended_lengths(stats)


def evaluation_report(gen: DataFrame, keys=("article_id", "language", "model"), by=("model",),
                      with_lcs: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """One row per model: mean ROUGE-1/2 (P/R/F; L and Lsum F when ``with_lcs``)
    plus mean and median lengths, their ratio and correlation.  Per-pair scores
    come from one Arrow step and are aggregated per model (partial
    aggregation), then the small per-model results are joined.

    With ``vectors`` (keys, ``side``, ``pos``, ``embedding``: token vectors of the
    generated texts, side ``cand``, and the references, side ``ref``) the mean embedding
    P/R/F comes along; a pair without vectors scores 0.0."""
    from pairlab.operators import metrics as M
    from pairlab.operators.ranking import null_safe_join
    keys, by = list(keys), list(by)
    scores = M.rouge_all(gen, keys, (1, 2), with_lcs, with_lcs)
    metrics = [f"rouge{n}_{x}" for n in (1, 2) for x in "prf"] + (["rougeL_f", "rougeLsum_f"] if with_lcs else [])
    means = M.mean_rouge(scores, by, metrics).drop("n_rows")
    report = null_safe_join(means, PR.summary_length_metrics(gen, by), by)
    if vectors is None:
        return report
    emb = ["emb_p", "emb_r", "emb_f"]
    matched = M.embedding_match_score(vectors, keys)
    each = null_safe_join(gen.select(*keys), matched, keys, "left")
    return null_safe_join(report, each.groupBy(*by).agg(*(F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in emb)), by)


def build_parallel_corpus(pages: DataFrame, links: DataFrame, lang_pages: DataFrame, languages,
                          base_lang: str = "en", per_category: int = 30, min_len: int = 1000,
                          max_sets: int | None = None) -> DataFrame:
    """Category scan -> parallel article sets.

    cap_per_category -> dedupe_first_seen -> filter_namespace ->
    resolve_langlinks -> filter_min_length -> parallel_complete -> article_id
    -> first ``max_sets`` sets in scan order.  Every step is a partial
    aggregate, a window over bounded groups or an equi-join.

    ``pages``: (name, category, category_rank, pos, namespace, language);
    ``links``: (page, lang, target, position); ``lang_pages``: (language,
    title, doc_id, n_text), ``n_text`` being the length of the text.
    """
    from pairlab.functions import text as T
    from pairlab.operators import corpus as C
    base_pages = pages.filter(F.col("language") == base_lang)
    capped = C.cap_per_category(base_pages, per_category).drop("rank")
    seen = C.filter_namespace(C.dedupe_first_seen(capped, "name", ("category_rank", "pos")))
    base = seen.select(F.col("name").alias("page"), "category_rank", "pos")
    # the base page is its own base-language "link" (listed first, so a real
    # link to another base-language page would override it, as in the scan)
    own = base.select("page", F.lit(base_lang).alias("lang"), F.col("page").alias("target"),
                      F.lit(-1).cast("bigint").alias("position"))
    all_links = links.select("page", "lang", "target", F.col("position").cast("bigint")).unionByName(own)
    rows = C.resolve_langlinks(base, all_links, lang_pages).select("page", "lang", "doc_id", "n_text")
    sets = C.parallel_complete(rows, languages, id_col="page", lang_col="lang", min_len=min_len, length="n_text")
    if max_sets is not None:
        first = C.limit_in_order(base.join(sets.select("page").distinct(), "page", "left_semi"),
                                 max_sets, ["category_rank", "pos", "page"]).select("page")
        sets = sets.join(first, "page", "left_semi")
    return sets.select(T.article_id("page").alias("article_id"), "page", F.col("lang").alias("language"), "doc_id")


def build_pair_dataset(articles: DataFrame, summaries: DataFrame, per_language: int | None = None,
                       order: str = "doc_id", train: float = 0.8, val: float = 0.1, test: float = 0.1,
                       seed: int = 42) -> DataFrame:
    """join_article_summary -> (cap_per_language) -> three_way_split.

    ``order`` is a number or ``article_id``, which is a lower-case hex digest."""
    from pairlab.operators import corpus as C
    from pairlab.operators.ranking import hex_bucket
    pairs = C.join_article_summary(articles, summaries)
    if per_language is not None:
        bucket = hex_bucket(F.col(order)) if order == "article_id" else None
        pairs = C.cap_per_language(pairs, per_language, order=(order,), bucket=bucket).drop("rank")
    return C.three_way_split(pairs, train, val, test, seed, by=["language"], key="article_id")


FIELDS = ["article_id", "language", "split", "title", "url", "text", "summary"]


def build_pair_dataset_files(spark: SparkSession, index: str, articles: str, summaries: str, out: str, now: str,
                             max_articles: int | None = None, per_language: int | None = None,
                             seed: int = 42) -> DataFrame:
    """From files to files: article index -> (first ``max_articles`` ids) -> their
    articles and summaries -> ``build_pair_dataset`` -> ``out/dataset`` by language
    and split, and ``out/metadata``.  Returns the dataset as written."""
    from pairlab.operators import corpus as C
    from pairlab.sources import readers as R
    from pairlab.sources import writers as W
    ids = R.read_article_index(spark, index, json_lines=True).select("id")
    if max_articles is not None:
        ids = C.limit_in_order(ids, max_articles, ["id"])
    found, _ = R.read_articles(spark, articles, layout="lines")
    found = found.join(ids, F.col("article_id") == F.col("id"), "left_semi")
    shorts, _ = R.read_summaries(spark, summaries, layout="lines")
    dataset = build_pair_dataset(found, shorts, per_language, "article_id", seed=seed).select(*FIELDS)
    W.write_split_dataset(dataset, os.path.join(out, "dataset"))
    written = R.read_split_dataset(spark, os.path.join(out, "dataset")).select(*FIELDS)
    config = {"max_articles": max_articles, "per_language": per_language, "seed": seed}
    W.write_run_metadata(written, os.path.join(out, "metadata"), config, now)
    return written


def clean_summaries(summaries: DataFrame, col: str = "summary") -> DataFrame:
    """Keep only the first line of every summary."""
    from pairlab.functions import text as T
    return summaries.withColumn(col, T.first_line(col))


def clean_summary_files(spark: SparkSession, src: str, dst: str | None = None) -> str:
    """Summary records under ``src`` -> first lines -> ``dst``, or ``src`` in place."""
    from pairlab.sources import readers as R
    from pairlab.sources import writers as W
    records, _ = R.read_summaries(spark, src, layout="lines")
    return W.rewrite_or_copy(clean_summaries(records), src, dst, "json", ["language"])


def evaluate_models(df: DataFrame, generators: dict, keys, prompt: str = "prompt",
                    reference: str = "reference", out: str | None = None, n_examples: int = 10,
                    seed: int = 42) -> DataFrame:
    """Every model on the same rows -> per-model ROUGE and length report.

    With ``out`` the report is also written to ``out/metrics`` (CSV), and a seeded
    sample of ``n_examples`` rows to ``out/examples`` (JSON lines): the start of the
    source, the reference and a ``summary_<model>`` for each model.

    The generated outputs are materialised once (reliable checkpoint in the
    shared folder): generation is the expensive, possibly non-deterministic
    step and must neither run twice nor be recomputed after executor loss.
    """
    from pairlab.operators import generate as G
    gen = G.generate_all(df, generators, keys, prompt, reference)
    keys = list(keys)
    report = evaluation_report(gen.withColumnRenamed(reference, "reference"), keys=keys + ["model"], with_lcs=True)
    if out is None:
        return report
    from pairlab.functions import text as T
    from pairlab.operators import corpus as C
    from pairlab.operators import metrics as M
    from pairlab.operators.ranking import null_safe_join
    from pairlab.sources import writers as W
    W.write_metrics_csv(report, os.path.join(out, "metrics"))
    shown = C.sample_without_replacement(df.select(*keys, prompt, reference), n_examples, seed, keys)
    # a few rows, worked out once
    shown = cut_lineage(shown.select(*keys, T.truncate_always_ellipsis(prompt, 1000).alias("source"), F.col(reference).alias("reference")))
    outputs = M.side_by_side(null_safe_join(gen.drop(reference), shown.select(*keys), keys), keys, list(generators))
    outputs = outputs.select(*keys, *[F.col(m).alias(f"summary_{m}") for m in generators])
    null_safe_join(shown, outputs, keys).write.mode("overwrite").json(os.path.join(out, "examples"))
    return report


def judge_report(comparisons: DataFrame, make_judge, by=("language",)) -> DataFrame:
    """comparisons (title, reference, base, finetuned) -> judge -> statistics."""
    from pairlab.functions import prompts as P
    from pairlab.operators import generate as G
    from pairlab.operators import judge as J
    j = comparisons.withColumn("judge_prompt", P.judge_prompt("title", "reference", "base", "finetuned"))
    judged = G.judge_batch(j, make_judge)
    return J.judge_statistics(judged, by)


def judge_report_files(spark: SparkSession, comparisons: str, out: str, make_judge, judge_model: str, n: int = 100,
                       json_lines: bool = True) -> DataFrame:
    """Comparison documents -> judge their first ``n`` pairs -> result documents with
    statistics, one for each run, under ``out``.  A run is told by its config; it
    holds ``n`` pairs at most, so its nested document is bounded.  The judged pairs
    are checkpointed once: results and statistics read the same answers.  Returns
    the statistics as written."""
    from pairlab.functions import prompts as P
    from pairlab.operators import generate as G
    from pairlab.operators import judge as J
    from pairlab.session import cut_lineage
    from pairlab.sources import readers as R
    pairs = R.read_comparisons(spark, comparisons, n, json_lines)
    pairs = pairs.select(F.to_json("config").alias("run"), "index", "title",
                         P.judge_prompt("title", "reference_summary", "base_model_summary", "finetuned_model_summary").alias("judge_prompt"))
    judged = cut_lineage(G.judge_batch(pairs, make_judge))
    results = judged.groupBy("run").agg(F.sort_array(F.collect_list(F.struct(
        "index", "title", "base_score", "finetuned_score", "explanation", "improvement"))).alias("evaluation_results"))
    stats = J.judge_statistics(judged, ["run"])
    doc = results.join(stats.select("run", F.struct(*[c for c in stats.columns if c != "run"]).alias("statistics")), "run")
    doc.select(F.lit(judge_model).alias("model"), F.from_json("run", "map<string,string>").alias("config"),
               "evaluation_results", "statistics").write.mode("overwrite").json(out)
    return R.read_judge_statistics(spark, out, json_lines=True)
