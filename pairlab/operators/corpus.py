"""Corpus assembly: filters, joins, de-duplication, caps, sampling, splits.

Every function is DataFrame -> DataFrame and lazy.  Ordered caps and
splits use the two-level ranking of ``pairlab.operators.ranking`` so that a
handful of languages never funnels the corpus through a handful of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions import text as T
from pairlab.operators.key_filter import filtered_anti_join
from pairlab.operators.ranking import balanced_bucket, hex_bucket, null_safe_join, ranked, seeded_key
from pairlab.sources.layout import any_null, not_null


# ---------------------------------------------------------------- filters

def filter_namespace(df: DataFrame, ns: int = 0, col: str = "namespace") -> DataFrame:
    return df.filter(F.col(col) == ns)


def filter_min_length(df: DataFrame, n: int = 1000, col: str = "text") -> DataFrame:
    """Drop rows whose text is shorter than ``n`` code points (equal kept)."""
    return df.filter(F.length(col) >= n)


def filter_short_pairs(df: DataFrame, min_text: int = 100, min_summary: int = 10,
                       text: str = "text", summary: str = "summary") -> DataFrame:
    return df.filter((F.length(text) >= min_text) & (F.length(summary) >= min_summary))


def trim_long_summaries(df: DataFrame, max_len: int = 2000, summary: str = "summary") -> DataFrame:
    return df.withColumn(summary, F.substring(summary, 1, max_len))


def prepare_pairs(df: DataFrame, min_text: int = 100, min_summary: int = 10,
                  max_summary: int = 2000, by: str = "split") -> DataFrame:
    """Trim first, then filter; returns the kept rows per ``by`` value."""
    kept = filter_short_pairs(trim_long_summaries(df, max_summary), min_text, min_summary)
    return kept.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))


def non_empty_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop rows whose text is missing or whitespace only."""
    return df.filter(T.has_text(col))


def with_quality_issues(df: DataFrame, col: str = "text", out: str = "issues") -> DataFrame:
    return df.withColumn(out, T.article_quality_issues(col))


def skip_problematic(df: DataFrame, col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row report with the skipped count)."""
    flagged = with_quality_issues(df, col)
    kept = flagged.filter(F.size("issues") == 0).drop("issues")
    report = flagged.agg(F.count_if(F.size("issues") > 0).alias("skipped"),
                         F.count_if(F.size("issues") == 0).alias("kept"))
    return kept, report


# ---------------------------------------------------------------- joins

def join_article_summary(articles: DataFrame, summaries: DataFrame,
                         keys: Sequence[str] = ("article_id", "language")) -> DataFrame:
    """Inner equi-join on (article_id, language): non-blank text, non-empty summary.

    Both sides are large; Spark plans a sort-merge (or AQE-chosen) join on
    the keys, the filters run before the exchange.
    """
    a = non_empty_text(articles)
    s = summaries.filter(F.col("summary").isNotNull() & (F.col("summary") != ""))
    s = s.select(*keys, "summary")
    return a.join(s, list(keys), "inner")


def join_audit(articles: DataFrame, summaries: DataFrame,
               keys: Sequence[str] = ("article_id", "language")) -> DataFrame:
    """Outcome per (article, language): ok / missing content / missing summary."""
    keys = list(keys)
    a = articles.select(*keys, (F.col("text").isNotNull() & (T.utrim("text") != "")).alias("_has_text"))
    s = summaries.select(*keys, (F.col("summary").isNotNull() & (F.col("summary") != "")).alias("_has_sum"))
    j = a.join(s, keys, "left")
    return j.select(*keys, F.when(~F.col("_has_text"), F.lit("missing content"))
                    .when(F.coalesce(F.col("_has_sum"), F.lit(False)), F.lit("ok"))
                    .otherwise(F.lit("missing summary")).alias("outcome"))


def join_audit_counts(audit: DataFrame, by: Sequence[str] = ("language",)) -> DataFrame:
    return audit.groupBy(*by, "outcome").agg(F.count(F.lit(1)).alias("n"))


def resume_anti_join(df: DataFrame, done: DataFrame, keys: Sequence[str], pages: DataFrame | None = None) -> DataFrame:
    """Rows whose key was not processed yet (left anti join; a null key equals a null key).

    With ``pages``, the stored filter of the done keys (``key_filter``), only
    rows that may be done meet the done keys.
    """
    if pages is not None:
        return filtered_anti_join(df, done, keys, pages)
    # keys without nulls join by plain equality, which co-partitioned tables do without a shuffle
    keys = list(keys)
    done = done.select(*keys)
    plain = not_null(df, keys).join(not_null(done, keys), keys, "left_anti").select(*df.columns)
    return plain.unionByName(null_safe_join(any_null(df, keys), any_null(done, keys).distinct(), keys, "left_anti"))


def pending_keys(index: DataFrame, done: DataFrame, keys: Sequence[str], pages: DataFrame | None = None) -> DataFrame:
    """Index keys minus completed keys (set difference on the key columns, nulls included)."""
    return resume_anti_join(index.select(*keys).distinct(), done, keys, pages)


def zip_by_position(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pair two row sets by an explicit row key (never by physical order)."""
    return left.join(right, list(key), "inner")


def dedupe_links(links: DataFrame, page: str = "page", lang: str = "lang",
                 position: str = "position") -> DataFrame:
    """One link per (page, language); a later listed link wins.

    Implemented as an aggregate (``max_by``) rather than a window so it
    partially aggregates before the shuffle.
    """
    return (links.groupBy(page, lang)
            .agg(F.max_by(F.struct(*[c for c in links.columns if c not in (page, lang)]),
                          F.col(position)).alias("_l"))
            .select(page, lang, "_l.*"))


def resolve_langlinks(base: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """base page x language links -> foreign page per language.

    ``base``: (page, ...) pages in the base language; ``links``: (page, lang,
    target, position); ``pages``: (language, title, ...) every language.
    """
    l = dedupe_links(links.join(base.select("page"), "page", "left_semi"))
    p = pages.withColumnRenamed("title", "target").withColumnRenamed("language", "lang")
    return l.join(p, ["lang", "target"], "inner")


def parallel_complete(df: DataFrame, languages: Sequence[str], id_col: str = "id",
                      lang_col: str = "language", text: str = "text",
                      min_len: int = 1000, length: str | None = None) -> DataFrame:
    """Relational division: ids having a valid row in *every* language.

    ``count(distinct language)`` per id is a partial aggregate (map-side),
    then the qualifying ids are semi-joined back.  ``length`` names a column that
    holds the text's length already, so that texts needn't ride along.
    """
    langs = list(languages)
    valid = df.filter(F.col(lang_col).isin(langs) & ((F.col(length) if length else F.length(text)) >= min_len))
    ok = (valid.groupBy(id_col).agg(F.count_distinct(lang_col).alias("_nl"))
          .filter(F.col("_nl") == len(langs)).select(id_col))
    return valid.join(ok, id_col, "left_semi")


def prompt_template_join(df: DataFrame, templates: DataFrame, lang_col: str = "language",
                         fallback: str = "en") -> DataFrame:
    """language -> template; unknown languages use ``fallback``'s template.

    The template table has one row per language a user wrote a template for;
    Spark broadcasts it where its measured size allows.  The fallback is one
    value: a scalar subquery, no join.
    """
    t = templates.select(F.col("language").alias("_tl"), F.col("template").alias("_tpl"))
    fb = templates.filter(F.col("language") == fallback).agg(F.max("template")).scalar()
    return (df.join(t, F.col(lang_col) == F.col("_tl"), "left")
            .withColumn("template", F.coalesce(F.col("_tpl"), fb))
            .drop("_tl", "_tpl"))


def model_cross_join(df: DataFrame, models: Sequence[str], col: str = "model") -> DataFrame:
    """Every model on the same rows: one output row per (row, model).

    The model list is a handful of names given by the user; each row is
    expanded with ``explode`` (no join, no shuffle).
    """
    return df.withColumn(col, F.explode(F.array(*[F.lit(m) for m in models])))


def article_id_audit(df: DataFrame, title: str = "title", width: int = 10) -> DataFrame:
    """Ids shared by more than one distinct title (hash-prefix collisions)."""
    ids = df.select(T.article_id(title, width).alias("article_id"), title)
    return (ids.groupBy("article_id").agg(F.count_distinct(title).cast("bigint").alias("n_titles"))
            .filter(F.col("n_titles") > 1))


# ---------------------------------------------------------------- windows

def dedupe_first_seen(df: DataFrame, key: str = "name",
                      order: Sequence[str] = ("category_rank", "pos")) -> DataFrame:
    """Keep the first occurrence of each key in scan order.

    ``min_by`` over a struct is a partial aggregate: duplicates collapse map
    side, only one row per key and partition crosses the shuffle.
    """
    others = [c for c in df.columns if c != key]
    order_struct = F.struct(*[F.col(c) for c in order])
    return (df.groupBy(key)
            .agg(F.min_by(F.struct(*[F.col(c) for c in others]), order_struct).alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in others]))


def cap_per_group(df: DataFrame, k: int, by: Sequence[str], order: Sequence[str],
                  bucket: Column | None = None, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group in ``order`` (exact, with a rank column)."""
    order_cols = [F.col(c) for c in order]
    if bucket is None:
        bucket = balanced_bucket(df, order[0], then=order[1:])
    return ranked(df, by, order_cols, bucket, name=name, limit=k)


def cap_per_category(df: DataFrame, k: int, category: str = "category",
                     order: Sequence[str] = ("pos",)) -> DataFrame:
    return cap_per_group(df, k, [category], order)


def cap_per_language(df: DataFrame, k: int, language: str = "language",
                     order: Sequence[str] = ("index_pos",), bucket: Column | None = None) -> DataFrame:
    """``bucket``: as for ``ranked``; needed where the first order column isn't a number."""
    return cap_per_group(df, k, [language], order, bucket)


def cap_shortage(df: DataFrame, k: int, language: str = "language") -> DataFrame:
    """Collected vs requested per language, with a shortage flag."""
    return (df.groupBy(language).agg(F.count(F.lit(1)).alias("collected"))
            .withColumn("requested", F.lit(k).cast("bigint"))
            .withColumn("shortage", F.col("collected") < F.col("requested")))


# ---------------------------------------------------------------- sort / sample / split

def limit_in_order(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in index order: a top-n (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


select_first_n = limit_in_order


def seeded_order(df: DataFrame, seed: int, key: str, name: str = "_h") -> DataFrame:
    return df.withColumn(name, seeded_key(key, seed))


def seeded_sample(df: DataFrame, n: int, seed: int, key: str | Sequence[str],
                  predicate: Column | None = None) -> DataFrame:
    """Seeded shuffle, keep the first ``n`` rows that pass ``predicate``.

    The order is md5("{seed}:{key}") of the first key, then all keys, then the other
    columns -- reproducible in any engine, and total but for equal rows.  The
    limit is the feature (a sample of n rows): a top-n, bounded per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    d = df.filter(predicate) if predicate is not None else df
    rest = [f.name for f in df.schema.fields if f.name not in keys and "map<" not in f.dataType.simpleString()]
    return seeded_order(d, seed, keys[0]).orderBy("_h", *keys, *(f"`{c}`" for c in rest)).limit(n).drop("_h")


def sample_without_replacement(df: DataFrame, n: int, seed: int, key: str | Sequence[str]) -> DataFrame:
    """min(n, size) distinct rows in seeded order."""
    return seeded_sample(df, n, seed, key)


def split_sizes(n: Column, train: float, val: float, test: float) -> tuple[Column, Column]:
    """(n_test, n_val) exactly as two successive seeded train/test cuts.

    n_test = ceil(n * t/(tr+v+t)); n_val = ceil((n - n_test) * v/(tr+v)),
    both in float64 (so 5000 rows at .8/.1/.1 give 3999/501/500).
    """
    total = train + val + test
    if abs(total - 1.0) > 1e-10:
        raise ValueError(f"split ratios must sum to 1, got {total}")
    test_frac = test / (train + val + test)
    val_frac = val / (train + val)
    n_test = F.ceil(n.cast("double") * F.lit(test_frac))
    n_val = F.ceil((n - n_test).cast("double") * F.lit(val_frac))
    return n_test.cast("bigint"), n_val.cast("bigint")


def three_way_split(df: DataFrame, train: float = 0.8, val: float = 0.1, test: float = 0.1,
                    seed: int = 42, by: Sequence[str] = ("language",), key: str = "article_id",
                    split_col: str = "split") -> DataFrame:
    """Exact per-group train/validation/test assignment.

    Rows are ranked in seeded-hash order inside each group (two-level rank,
    buckets = leading hash digits); ranks 1..n_test are test, the next n_val
    validation, the rest train.  Group sizes are summed from the same bucket
    sizes the rank uses (no extra pass over the rows).
    """
    by = list(by)
    h = seeded_order(df, seed, key)
    r = ranked(h, by, [F.col("_h"), F.col(key)], hex_bucket(F.col("_h")), name="_rank", total="_n")
    n_test, n_val = split_sizes(F.col("_n"), train, val, test)
    return (r.withColumn(split_col, F.when(F.col("_rank") <= n_test, F.lit("test"))
                         .when(F.col("_rank") <= n_test + n_val, F.lit("validation"))
                         .otherwise(F.lit("train")))
            .drop("_h", "_rank", "_n"))


def split_counts(df: DataFrame, language: str = "language", split: str = "split") -> DataFrame:
    """Rows per language x split plus the language total (one pivot)."""
    return (df.groupBy(language).pivot(split, ["train", "validation", "test"])
            .agg(F.count(F.lit(1)))
            .select(language,
                    *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s)
                      for s in ("train", "validation", "test")])
            .withColumn("total", F.col("train") + F.col("validation") + F.col("test")))


def batch_assign(df: DataFrame, size: int, order: Sequence[str], by: Sequence[str] = (),
                 name: str = "batch") -> DataFrame:
    """Consecutive batches of ``size`` rows in index order (exact)."""
    order_cols = [F.col(c) for c in order]
    bucket = balanced_bucket(df, order[0], then=order[1:])
    r = ranked(df, list(by), order_cols, bucket, name="_pos")
    return r.withColumn(name, F.floor((F.col("_pos") - 1) / size).cast("bigint")).drop("_pos")
