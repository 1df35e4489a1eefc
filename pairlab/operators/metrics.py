"""Summary-quality metrics: ROUGE-N/L/Lsum and the embedding match score.

ROUGE-N follows the published definition (Lin, 2004): n-gram overlap with
clipped counts (``counts="clipped"``) or set semantics (``"distinct"``).
Two interchangeable engines (identical results):

* ``arrow`` (default) -- JVM tokenisation, then each pair's n-gram multiset
  intersection is counted in its own task by a small Arrow-batched helper:
  no shuffle, work linear in the text;
* ``spark`` -- built-in operators only:

    explode(n-grams of both sides + one sentinel per pair)
      -> groupBy(pair, gram)   count per side      (partial agg, shuffle 1)
      -> groupBy(pair)         sum(least(...))     (partial agg, tiny shuffle 2)

  which ships every distinct n-gram of every pair through shuffle 1.

A pair whose generation has no tokens scores 0.0 (the reference's failure
value).

ROUGE-L needs a longest common subsequence, which no SQL operator
expresses; it runs in an Arrow UDF with the bit-parallel
LCS (Crochemore et al. 2001 / Hyyro 2004): O(|a|*|b|/word) per pair on
whole texts (no token cap).  Only the two token arrays cross into Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions import text as TX
from pairlab.functions.pieces import pieces
from pairlab.functions.tokenizers import tokens

ROUGE_TOKENIZER = "word"


def ngrams(toks: Column, n: int) -> Column:
    """Array of space-joined n-grams (empty when fewer than n tokens)."""
    if n == 1:
        return toks
    if n == 2:
        return F.when(F.size(toks) >= 2,
                      F.zip_with(F.slice(toks, 1, F.size(toks) - 1), F.slice(toks, 2, F.size(toks)),
                                 lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(toks) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1),
                              lambda i: F.array_join(F.slice(toks, i, n), " "))
                  ).otherwise(F.array().cast("array<string>"))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def _pairs(hyp: pa.Array, ref: pa.Array) -> Iterator[tuple[list, list]]:
    """The lists of both sides (null: empty), as Python objects for one piece of the batch at a time."""
    for both in pieces(pa.RecordBatch.from_arrays([hyp, ref], names=["hyp", "ref"])):
        for h, r in zip(both.column(0).to_pylist(), both.column(1).to_pylist()):
            yield h or [], r or []


def _structs(rows: list, names: list[str], kind: pa.DataType) -> pa.Array:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, kind) for c in columns], names=names)


def _overlap_udf(ns: Sequence[int], counts: str):
    """Arrow UDF: per pair and order n, (overlap, hyp n-grams, ref n-grams)."""
    from collections import Counter
    fields = []
    for n in ns:
        fields += [T.StructField(f"o{n}", T.LongType()), T.StructField(f"h{n}", T.LongType()),
                   T.StructField(f"r{n}", T.LongType())]
    schema = T.StructType(fields)

    def grams(toks: list, n: int) -> Counter:
        return Counter(zip(*[toks[i:] for i in range(n)]))

    @F.arrow_udf(schema)
    def overlap(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        rows = []
        for h, r in _pairs(hyp, ref):
            row = []
            for n in ns:
                ch, cr = grams(h, n), grams(r, n)
                if counts == "clipped":
                    row += [sum((ch & cr).values()), sum(ch.values()), sum(cr.values())]
                else:
                    row += [len(ch.keys() & cr.keys()), len(ch), len(cr)]
            rows.append(row)
        return _structs(rows, [f.name for f in fields], pa.int64())
    return overlap


def rouge_scores(df: DataFrame, keys: Sequence[str], ns: Sequence[int] = (1, 2), reference: str = "reference",
                 generated: str = "generated", counts: str = "clipped", tokenizer: str = ROUGE_TOKENIZER,
                 prefix: str = "rouge", engine: str = "arrow") -> DataFrame:
    """Per pair precision / recall / F1 of n-gram overlap for every n in ``ns``.

    Output: keys + ``{prefix}{n}_p``, ``{prefix}{n}_r``, ``{prefix}{n}_f``.

    ``engine="arrow"`` (default): tokens are produced by JVM regexes and the
    n-gram multiset intersection of each pair is counted inside its own task
    by a small Arrow-batched helper -- no shuffle at all, work linear in the
    text.  ``engine="spark"``: the same counts with built-in operators only
    (explode + two aggregations; the first shuffle carries every distinct
    n-gram of every pair, which is what makes it the slower plan at scale).
    Both give identical results (tests assert it).
    """
    keys = list(keys)
    if counts not in ("clipped", "distinct"):
        raise ValueError(counts)
    if engine == "arrow":
        c = df.select(*keys, _overlap_udf(tuple(ns), counts)(tokens(F.col(generated), tokenizer),
                                                           tokens(F.col(reference), tokenizer)).alias("_c"))
        out = [F.col(k) for k in keys]
        for n in ns:
            o, h, r = F.col(f"_c.o{n}"), F.col(f"_c.h{n}"), F.col(f"_c.r{n}")
            p_ = F.when(h > 0, o / h).otherwise(F.lit(0.0))
            r_ = F.when((r > 0) & (h > 0), o / r).otherwise(F.lit(0.0))
            out += [p_.alias(f"{prefix}{n}_p"), r_.alias(f"{prefix}{n}_r"), _f1(p_, r_).alias(f"{prefix}{n}_f")]
        return c.select(*out)
    htok = tokens(F.col(generated), tokenizer)
    rtok = tokens(F.col(reference), tokenizer)
    def tag(n: int, side: int):
        # a one-argument lambda: Spark's transform passes the index to a 2-argument one
        return lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(side).alias("s"))

    parts = []
    for n in ns:
        parts.append(F.transform(ngrams(htok, n), tag(n, 0)))
        parts.append(F.transform(ngrams(rtok, n), tag(n, 1)))
    # one sentinel per pair keeps pairs without any n-gram in the result
    parts.append(F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("g"), F.lit(2).alias("s"))))
    ex = df.select(*keys, F.explode(F.concat(*parts)).alias("_t")).select(*keys, "_t.n", "_t.g", "_t.s")
    per_gram = ex.groupBy(*keys, "n", "g").agg(F.count_if(F.col("s") == 0).alias("ch"),
                                               F.count_if(F.col("s") == 1).alias("cr"))
    if counts == "clipped":
        ov, nh, nr = F.least("ch", "cr"), F.col("ch"), F.col("cr")
    elif counts == "distinct":
        ov = ((F.col("ch") > 0) & (F.col("cr") > 0)).cast("long")
        nh, nr = (F.col("ch") > 0).cast("long"), (F.col("cr") > 0).cast("long")
    else:
        raise ValueError(counts)
    aggs = []
    for n in ns:
        on = F.col("n") == n
        aggs += [F.sum(F.when(on, ov).otherwise(0)).alias(f"_ov{n}"), F.sum(F.when(on, nh).otherwise(0)).alias(f"_nh{n}"),
                 F.sum(F.when(on, nr).otherwise(0)).alias(f"_nr{n}")]
    per_pair = per_gram.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys]
    for n in ns:
        o, h, r = F.col(f"_ov{n}"), F.col(f"_nh{n}"), F.col(f"_nr{n}")
        p_ = F.when(h > 0, o / h).otherwise(F.lit(0.0))
        r_ = F.when((r > 0) & (h > 0), o / r).otherwise(F.lit(0.0))
        out += [p_.alias(f"{prefix}{n}_p"), r_.alias(f"{prefix}{n}_r"), _f1(p_, r_).alias(f"{prefix}{n}_f")]
    return per_pair.select(*out)


def rouge_n(df: DataFrame, keys: Sequence[str], n: int = 1, **kw) -> DataFrame:
    """ROUGE-N for a single order (see ``rouge_scores``)."""
    return rouge_scores(df, keys, (n,), **kw)


# ----------------------------------------------------------------- LCS family

def lcs_length(a: Sequence, b: Sequence) -> int:
    """Bit-parallel LCS length; one big-int step per token of ``b``."""
    if not len(a) or not len(b):
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for tok in b:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def lcs_positions(a: Sequence, b: Sequence) -> set[int]:
    """Positions in ``a`` of one LCS of (a, b).

    Bit-parallel rows (one big int of len(a) bits per token of ``b``) are
    kept for the backtrack: memory is len(a) * len(b) / 8 bytes, not a
    table of Python ints.  Row j's DP value at prefix length i is the number
    of zero bits of V_j below i.
    """
    m, n = len(a), len(b)
    if not m or not n:
        return set()
    masks: dict = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << m) - 1
    rows = [full]
    v = full
    for tok in b:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)

    def dp(j: int, i: int) -> int:  # LCS of a[:i], b[:j]
        return i - bin(rows[j] & ((1 << i) - 1)).count("1")

    out, i, j = set(), m, n
    cur = dp(j, i)
    while i > 0 and j > 0 and cur > 0:
        if a[i - 1] == b[j - 1] and dp(j - 1, i - 1) == cur - 1:
            out.add(i - 1)
            i, j, cur = i - 1, j - 1, cur - 1
        elif dp(j - 1, i) == cur:
            j -= 1
        else:
            i -= 1
    return out


def _prf(hit: float, n_hyp: int, n_ref: int) -> tuple[float, float, float]:
    if n_hyp == 0 or n_ref == 0:
        return 0.0, 0.0, 0.0
    p, r = hit / n_hyp, hit / n_ref
    return p, r, (2.0 * p * r / (p + r)) if p + r > 0 else 0.0


_PRF = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType()),
                     T.StructField("f", T.DoubleType())])


@F.arrow_udf(_PRF)
def _rouge_l_udf(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    rows = [_prf(lcs_length(h, r), len(h), len(r)) for h, r in _pairs(hyp, ref)]
    return _structs(rows, ["p", "r", "f"], pa.float64())


@F.arrow_udf(_PRF)
def _rouge_lsum_udf(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """Summary-level LCS: per reference sentence, union of LCS hits with
    every generated sentence (Lin 2004, section 3.2)."""
    rows = []
    for hs, rs in _pairs(hyp, ref):
        n_h, n_r = sum(map(len, hs)), sum(map(len, rs))
        hit = 0
        for rsent in rs:
            union: set[int] = set()
            for hsent in hs:
                union |= lcs_positions(rsent, hsent)
            hit += len(union)
        rows.append(_prf(hit, n_h, n_r))
    return _structs(rows, ["p", "r", "f"], pa.float64())


def rouge_l(df: DataFrame, keys: Sequence[str], reference: str = "reference", generated: str = "generated",
            tokenizer: str = ROUGE_TOKENIZER, prefix: str = "rougeL") -> DataFrame:
    """LCS-based P/R/F1 per pair (whole texts)."""
    s = df.select(*keys, _rouge_l_udf(tokens(F.col(generated), tokenizer),
                                      tokens(F.col(reference), tokenizer)).alias("_s"))
    return s.select(*keys, F.col("_s.p").alias(f"{prefix}_p"), F.col("_s.r").alias(f"{prefix}_r"),
                    F.col("_s.f").alias(f"{prefix}_f"))


def _sentence_tokens(col: str, tokenizer: str) -> Column:
    lines = F.split(TX.sentence_lines(F.col(col)), "\n")
    return F.filter(F.transform(lines, lambda l: tokens(l, tokenizer)), lambda a: F.size(a) > 0)


def rouge_lsum(df: DataFrame, keys: Sequence[str], reference: str = "reference", generated: str = "generated",
               tokenizer: str = ROUGE_TOKENIZER, prefix: str = "rougeLsum") -> DataFrame:
    """Summary-level ROUGE-L over newline-separated sentences (after
    ``sentence_lines``: one sentence per line)."""
    s = df.select(*keys, _rouge_lsum_udf(_sentence_tokens(generated, tokenizer),
                                         _sentence_tokens(reference, tokenizer)).alias("_s"))
    return s.select(*keys, F.col("_s.p").alias(f"{prefix}_p"), F.col("_s.r").alias(f"{prefix}_r"),
                    F.col("_s.f").alias(f"{prefix}_f"))


def rouge_all(df: DataFrame, keys: Sequence[str], ns: Sequence[int] = (1, 2), lcs: bool = True, lsum: bool = False,
              reference: str = "reference", generated: str = "generated", counts: str = "clipped",
              tokenizer: str = ROUGE_TOKENIZER, carry: Sequence[str | Column] = ()) -> DataFrame:
    """All wanted scores of a pair from one Arrow step on its own row: no join, no shuffle.

    Output: keys, the ``carry`` columns, ``rouge{n}_p/r/f`` and, where asked,
    ``rougeL_p/r/f`` and ``rougeLsum_p/r/f``.
    """
    hyp, ref = tokens(F.col(generated), tokenizer), tokens(F.col(reference), tokenizer)
    calls = [_overlap_udf(tuple(ns), counts)(hyp, ref).alias("_c")]
    if lcs:
        calls.append(_rouge_l_udf(hyp, ref).alias("_l"))
    if lsum:
        calls.append(_rouge_lsum_udf(_sentence_tokens(generated, tokenizer), _sentence_tokens(reference, tokenizer)).alias("_s"))
    c = df.select(*keys, *carry, *calls)
    out = [F.col(name) for name in c.columns if name not in ("_c", "_l", "_s")]
    for n in ns:
        o, h, r = F.col(f"_c.o{n}"), F.col(f"_c.h{n}"), F.col(f"_c.r{n}")
        p_ = F.when(h > 0, o / h).otherwise(F.lit(0.0))
        r_ = F.when((r > 0) & (h > 0), o / r).otherwise(F.lit(0.0))
        out += [p_.alias(f"rouge{n}_p"), r_.alias(f"rouge{n}_r"), _f1(p_, r_).alias(f"rouge{n}_f")]
    for flag, col, name in ((lcs, "_l", "rougeL"), (lsum, "_s", "rougeLsum")):
        out += [F.col(f"{col}.{x}").alias(f"{name}_{x}") for x in "prf"] if flag else []
    return c.select(*out)


def rouge_prf_table(df: DataFrame, keys: Sequence[str], with_lcs: bool = True, **kw) -> DataFrame:
    """P, R, F for ROUGE-1/2 (and F for ROUGE-L / Lsum when ``with_lcs``)."""
    return rouge_all(df, keys, (1, 2), with_lcs, with_lcs, **kw).drop("rougeL_p", "rougeL_r", "rougeLsum_p", "rougeLsum_r")


# ----------------------------------------------------------------- aggregates

def mean_rouge(scores: DataFrame, by: Sequence[str] = ("model",),
               metrics: Sequence[str] = ("rouge1_f", "rouge2_f"), exclude: Column | None = None) -> DataFrame:
    """Mean of each score per group; 0.0 for an empty group."""
    s = scores.filter(~exclude) if exclude is not None else scores
    return s.groupBy(*by).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics],
                              F.count(F.lit(1)).alias("n_rows"))


def rouge_improvement(means: DataFrame, metrics: Sequence[str] = ("rouge1_f", "rouge2_f"),
                      model: str = "model", base: str = "base", tuned: str = "finetuned",
                      by: Sequence[str] = ()) -> DataFrame:
    """(tuned - base) / base * 100 per metric; 0 when base <= 0."""
    by = list(by)
    aggs = []
    for m in metrics:
        b = F.max(F.when(F.col(model) == base, F.col(m)))
        t = F.max(F.when(F.col(model) == tuned, F.col(m)))
        aggs += [b.alias(f"base_{m}"), t.alias(f"finetuned_{m}")]
    w = means.groupBy(*by).agg(*aggs) if by else means.agg(*aggs)
    for m in metrics:
        b, t = F.col(f"base_{m}"), F.col(f"finetuned_{m}")
        w = w.withColumn(f"improvement_{m}", F.when(b > 0, (t - b) / b * 100).otherwise(F.lit(0.0)))
    return w


def best_worst_examples(scores: DataFrame, n: int = 5, by: Sequence[str] = ("model",),
                        metric: str = "rouge1_f", key: Sequence[str] = ("article_id", "language")) -> DataFrame:
    """``n`` lowest and ``n`` highest rows per group; ties broken by key.

    ``row_number() <= n`` is planned as a WindowGroupLimit: each task keeps
    its own top-n before the shuffle, so a huge group ships n rows per task.
    """
    from pairlab.session import cut_lineage
    k = [F.col(c) for c in key]
    # both lists read the scores: compute them once (narrow projection) and
    # checkpoint, instead of scoring every pair twice
    scores = cut_lineage(scores.select(*dict.fromkeys([*by, *key, metric, *scores.columns])))
    lo = Window.partitionBy(*by).orderBy(F.col(metric).asc(), *k)
    hi = Window.partitionBy(*by).orderBy(F.col(metric).desc(), *k)
    worst = scores.withColumn("_r", F.row_number().over(lo)).filter(F.col("_r") <= n).withColumn("kind", F.lit("worst"))
    best = scores.withColumn("_r", F.row_number().over(hi)).filter(F.col("_r") <= n).withColumn("kind", F.lit("best"))
    # both lists in ascending score order: the best list ends with the best row
    # (the count runs over the <= n kept rows of a group only)
    best = best.withColumn("_r", F.count(F.lit(1)).over(Window.partitionBy(*by)) + 1 - F.col("_r"))
    return worst.unionByName(best).withColumnRenamed("_r", "position")


def union_model_metrics(*dfs: DataFrame) -> DataFrame:
    """Append per-model metric rows (by column name)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def melt_metrics(wide: DataFrame, id_cols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(id_cols), list(metrics), "metric", "score")


def side_by_side(gen: DataFrame, keys: Sequence[str], models: Sequence[str], model: str = "model",
                 generated: str = "generated") -> DataFrame:
    """One column per model's output for each sample (pivot with fixed values)."""
    return gen.groupBy(*keys).pivot(model, list(models)).agg(F.first(generated))


def round_metrics(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """x100 and round (display form)."""
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c) * 100, digits))
    return df


def metric_grid_improvement(grid: DataFrame) -> DataFrame:
    """% improvement per (tuned, test, metric) from a long grid
    (tuned_lang, test_lang, variant, metric, score).  Missing tuned -> 0;
    missing base -> 0 in the numerator and 1 in the denominator."""
    w = (grid.groupBy("tuned_lang", "test_lang", "metric")
         .pivot("variant", ["base_model", "finetuned_model"]).agg(F.first("score")))
    b = F.col("base_model")
    ft = F.coalesce(F.col("finetuned_model"), F.lit(0.0))
    return w.select("tuned_lang", "test_lang", "metric",
                    (F.try_divide(ft - F.coalesce(b, F.lit(0.0)), F.coalesce(b, F.lit(1.0))) * 100)
                    .alias("improvement"))


# ----------------------------------------------------------------- embedding score

VECTOR_TILE = 1024  # vectors of each side in one matrix product


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def greedy_match(cand: np.ndarray, ref: np.ndarray, tile: int = VECTOR_TILE) -> tuple[float, float]:
    """Mean over the rows of each side of the greatest cosine with a row of the other; 0.0 if a side is empty.

    Similarities are matrix products of ``tile`` by ``tile`` rows; only the
    running maxima of rows and columns outlive a tile.
    """
    if not len(cand) or not len(ref):
        return 0.0, 0.0
    cand, ref = _unit_rows(cand), _unit_rows(ref)
    rows, columns = np.full(len(cand), -np.inf), np.full(len(ref), -np.inf)
    for i in range(0, len(cand), tile):
        for j in range(0, len(ref), tile):
            sims = cand[i:i + tile] @ ref[j:j + tile].T
            np.maximum(rows[i:i + tile], sims.max(1), out=rows[i:i + tile])
            np.maximum(columns[j:j + tile], sims.max(0), out=columns[j:j + tile])
    return float(rows.mean()), float(columns.mean())


def _matched(tile: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, which side, vector) sorted by row -> (row, emb_p, emb_r); a pair may go on in the next batch."""
        key, held = None, ([], [], [])

        def parts(batch: pa.RecordBatch):
            """Stretches of one side of one pair: (row, side, matrix)."""
            row, which, vec = batch.columns
            changed = np.zeros(len(row), bool)
            for field in row.flatten():
                same = pc.equal(field.slice(1), field.slice(0, len(field) - 1))
                nulls = pc.and_(pc.is_null(field.slice(1)), pc.is_null(field.slice(0, len(field) - 1)))
                changed[1:] |= ~pc.or_(pc.fill_null(same, False), nulls).to_numpy(zero_copy_only=False)
            of = which.to_numpy(zero_copy_only=False)
            changed[1:] |= of[1:] != of[:-1]
            starts = np.r_[0, np.flatnonzero(changed)]
            lengths = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False)
            flat, ends = pc.list_flatten(vec).to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(lengths)]
            for a, b in zip(starts, np.r_[starts[1:], len(row)]):
                # rows without a vector count as zero vectors
                width = int(lengths[a:b].max(initial=0))
                m = np.zeros((b - a, width))
                whole = lengths[a:b] == width
                if (~whole & (lengths[a:b] > 0)).any():
                    raise ValueError("vectors of one pair differ in length")
                m[whole] = flat[ends[a]:ends[b]].reshape(-1, width) if width else 0.0
                yield row[a].as_py(), int(of[a]), m

        def done(k, sides):
            width = max((m.shape[1] for x in sides[:2] for m in x), default=0)
            # a stretch of missing vectors has no width of its own
            mats = [np.concatenate([m if m.shape[1] else np.zeros((len(m), width)) for m in x]) if x else np.zeros((0, width)) for x in sides[:2]]
            return k, *greedy_match(*mats, tile)

        def given(found):
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.float64()),
                                               pa.array([f[2] for f in found], pa.float64())], names=["row", "emb_p", "emb_r"])

        kind = None
        for batch in batches:
            kind, found = batch.schema.field(0).type, []
            if not batch.num_rows:
                continue
            for k, of, m in parts(batch):
                if key is not None and k != key:
                    found.append(done(key, held))
                    held = ([], [], [])
                key = k
                held[of].append(m)
            yield given(found)
        if key is not None:
            yield given([done(key, held)])
    return work


def embedding_match_score(vectors: DataFrame, pair: str | Sequence[str] = "pair_id", side: str = "side",
                          pos: str = "pos", vec: str = "embedding", cand: str = "cand",
                          ref: str = "ref", tile: int = VECTOR_TILE) -> DataFrame:
    """Greedy max-cosine P/R/F per pair on precomputed token vectors.

    A pair with an empty side scores 0.0.  P = mean over candidate tokens of the max cosine to any reference token,
    R symmetric, F harmonic mean.  Rows are brought together by pair and streamed
    through an Arrow step that multiplies bounded tiles of the two sides (a pair is one
    summary pair: its vectors, not its products, are held).
    """
    keys = [pair] if isinstance(pair, str) else list(pair)
    which = F.when(F.col(side) == cand, 0).when(F.col(side) == ref, 1).otherwise(2)  # others tell only that there is such a pair
    rows = vectors.select(F.struct(*keys).alias("row"), which.alias("which"), F.col(pos).alias("pos"), F.col(vec).cast("array<double>").alias("vec"))
    sorted_ = rows.repartition("row").sortWithinPartitions("row", "which", "pos").select("row", "which", "vec")
    found = sorted_.mapInArrow(_matched(tile), T.StructType([rows.schema["row"]]).add("emb_p", T.DoubleType()).add("emb_r", T.DoubleType()))
    return found.select("row.*", "emb_p", "emb_r").withColumn("emb_f", _f1(F.col("emb_p"), F.col("emb_r")))
