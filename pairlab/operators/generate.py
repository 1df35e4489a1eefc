"""User-function slots: batched maps, generators and judges.

No model is bundled.  A *generator* is a factory ``make() -> callable``
whose callable maps a list of prompts to a list of outputs; the factory runs
once per task (per partition), then every Arrow batch of the partition goes
through it -- the way a model is loaded once per executor and fed batches.
``mapInPandas`` carries the batches; filters and projections are applied
before it, since Spark cannot push filters through Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.operators.judge import parse_judge_scores

GeneratorFactory = Callable[[], Callable[[list[str]], list[str]]]

ON_ERROR = ("skip", "empty", "message")
ERROR_MESSAGE = "Error generating summary"


def map_batched(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """Apply ``fn`` to column batches; its output replaces all columns."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)


def filter_rows(df: DataFrame, predicate: Column | Callable[[pd.Series], pd.Series],
                col: str | None = None) -> DataFrame:
    """Keep rows where ``predicate`` holds: a Column expression (preferred,
    JVM side) or a vectorised boolean function of ``col``."""
    if isinstance(predicate, Column):
        return df.filter(predicate)
    udf = F.pandas_udf(lambda s: predicate(s).astype(bool), T.BooleanType())
    return df.filter(udf(F.col(col)))


def generate_batch(df: DataFrame, make_generator: GeneratorFactory, prompt: str = "prompt",
                   out: str = "generated", on_error: str = "empty", batch_size: int = 32) -> DataFrame:
    """Append ``out`` produced by the user's generator for each row.

    Per-row failures follow ``on_error``: ``skip`` drops the row, ``empty``
    yields "", ``message`` yields "Error generating summary".  A batch that
    fails as a whole is retried row by row so one bad input cannot sink its
    neighbours.
    """
    if on_error not in ON_ERROR:
        raise ValueError(on_error)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType())])
    fill = "" if on_error == "empty" else ERROR_MESSAGE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = make_generator()
        for b in batches:
            for start in range(0, len(b), batch_size):
                chunk = b.iloc[start:start + batch_size].copy()
                prompts = chunk[prompt].fillna("").tolist()
                try:
                    outs = list(gen(prompts))
                    ok = [True] * len(outs)
                except Exception:
                    outs, ok = [], []
                    for p in prompts:
                        try:
                            outs.append(gen([p])[0])
                            ok.append(True)
                        except Exception:
                            outs.append(fill)
                            ok.append(False)
                chunk[out] = outs
                if on_error == "skip":
                    chunk = chunk[ok]
                yield chunk
    return df.mapInPandas(run, schema)


_SENT = re.compile(r"(?<=[.!?])\s+")


def lead_sentences(k: int = 2) -> GeneratorFactory:
    """A deterministic baseline generator: the first ``k`` sentences."""
    def make():
        def gen(prompts: list[str]) -> list[str]:
            return [" ".join(_SENT.split(p)[:k]) for p in prompts]
        return gen
    return make


def judge_batch(df: DataFrame, make_judge: GeneratorFactory, prompt: str = "judge_prompt",
                on_error: str = "empty") -> DataFrame:
    """Run a judge over judge prompts, then parse its raw responses."""
    raw = generate_batch(df, make_judge, prompt, out="response", on_error=on_error)
    return parse_judge_scores(raw, "response")


def overlap_judge() -> GeneratorFactory:
    """A deterministic stand-in judge: scores A and B by word overlap with the
    reference found in the judge prompt and answers in the judge's JSON form."""
    ref_re = re.compile(r"Reference summary: (.*?)\n\nSummary A: (.*?)\n\nSummary B: (.*?)\n\nEvaluate", re.S)

    def score(a: str, ref: set[str]) -> int:
        w = set(a.lower().split())
        if not w or not ref:
            return 1
        f = 2 * len(w & ref) / (len(w) + len(ref))
        return 1 + min(4, int(f * 5))

    def make():
        def judge(prompts: list[str]) -> list[str]:
            outs = []
            for p in prompts:
                m = ref_re.search(p)
                if not m:
                    outs.append("no scores")
                    continue
                ref = set(m.group(1).lower().split())
                outs.append('{"score_a": %d, "score_b": %d, "explanation": "word overlap"}'
                            % (score(m.group(2), ref), score(m.group(3), ref)))
            return outs
        return judge
    return make


def generate_all(df: DataFrame, generators: dict[str, GeneratorFactory], keys: Sequence[str],
                 prompt: str = "prompt", reference: str = "reference", on_error: str = "message",
                 materialise: bool = True) -> DataFrame:
    """keys + model + generated + reference for every model on the same rows.

    With ``materialise`` the outputs are checkpointed once to the shared
    checkpoint folder, so later steps never re-run a generator.
    """
    from pairlab.session import cut_lineage
    keys = list(keys)
    outs = []
    for name, make in generators.items():
        g = generate_batch(df.select(*keys, prompt, reference), make, prompt, "generated", on_error)
        outs.append(g.withColumn("model", F.lit(name)).drop(prompt))
    gen = outs[0]
    for o in outs[1:]:
        gen = gen.unionByName(o)
    return cut_lineage(gen) if materialise else gen


def compare_models(df: DataFrame, generators: dict[str, GeneratorFactory], keys: Sequence[str],
                   prompt: str = "prompt", reference: str = "reference", on_error: str = "message") -> DataFrame:
    """Run every model's generator on the same rows and score each output
    with ROUGE-1/2 (P/R/F) and ROUGE-L (F) against the reference.
    Output: one row per (row, model)."""
    from pairlab.operators import metrics as M
    keys = list(keys)
    gen = generate_all(df, generators, keys, prompt, reference, on_error)
    k = keys + ["model"]
    return M.rouge_all(gen, k, (1, 2), reference=reference, carry=["generated"]).drop("rougeL_p", "rougeL_r")
