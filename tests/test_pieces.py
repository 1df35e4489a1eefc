"""Python steps hold the objects of a piece of an Arrow batch, never of the whole batch."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import pairlab.llm.parity_join as J
from pairlab.functions.pieces import pieces
from pairlab.functions.tokenizers import tokenizer_udf
from pairlab.operators import examples as X
from pairlab.operators import metrics as M

rng = random.Random(5)
WORDS = [f"w{rng.randrange(10 ** 6)}" for _ in range(30000)]
TEXTS = [" ".join(rng.choices(WORDS, k=400)) for _ in range(1200)]  # some 3 MB
TOKENS = [t.split()[:200] for t in TEXTS]


def peak_mb(steps):
    tracemalloc.start()
    for _ in steps:
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 2 ** 20


@pytest.mark.parametrize("most", [1, 50, 10 ** 9])
def test_pieces_are_the_rows_in_order(most):
    for rows in ([], [None], ["a" * 40, None, "", "b" * 200, "c"] * 7):
        array = pa.array(rows, pa.string())
        got = list(pieces(array, most))
        assert [x for p in got for x in p.to_pylist()] == rows
        assert all(len(p) <= 1 or p.nbytes <= most for p in got)
        batch = pa.RecordBatch.from_arrays([array, pa.array([[r] for r in rows], pa.list_(pa.string()))], names=["a", "b"])
        got = list(pieces(batch.slice(1), most))
        assert [x for p in got for x in p.column(1).to_pylist()] == [[r] for r in rows[1:]]


def test_signatures_and_sets_hold_one_piece():
    n, ids = len(TEXTS), pa.array(range(len(TEXTS)), pa.int64())
    text = pa.array(TEXTS)
    whole = pa.RecordBatch.from_arrays([ids, ids, ids, text], names=["doc_id", "ta", "tb", "text"])
    few = [whole.slice(k, 7) for k in range(0, n, 7)]
    same = [pa.Table.from_batches(J._signatures(iter(x))) for x in ([whole], few)]
    assert same[0].combine_chunks().equals(same[1].combine_chunks())
    assert peak_mb(J._signatures(iter([whole]))) < 30
    assert peak_mb(J._sets(iter([whole.select(["doc_id", "text"])]))) < 30


def test_distinct_tokens_hold_one_piece():
    batch = pa.RecordBatch.from_arrays([pa.array([{"k": k} for k in range(len(TOKENS))]), pa.array(TOKENS)], names=["row", "tokens"])
    got = [(r["row"]["k"], r["token"], r["positions"]) for b in X._distinct_tokens(iter([batch])) for r in b.to_pylist()]
    texts = [[None] * len(t) for t in TOKENS]
    for k, token, positions in got:
        for p in positions:
            texts[k][p] = token
    assert texts == TOKENS and len(got) == sum(len(set(t)) for t in TOKENS)
    assert peak_mb(X._distinct_tokens(iter([batch]))) < 8


def test_tokenizer_udf_holds_one_piece(spark):
    split = tokenizer_udf(lambda s: s.split())
    assert peak_mb(split.func(iter([pa.array(TEXTS)]))) < 15
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(-1, None), (-2, "")]
    df = spark.createDataFrame(rows, "k int, text string").repartition(2)
    # two calls in one projection
    got = {r.k: (r.a, r.b) for r in df.select("k", split("text").alias("a"), F.size(split(F.upper("text"))).alias("b")).collect()}
    assert got == {k: (None, None) if t is None else (t.split(), len(t.split())) for k, t in rows}


@pytest.mark.parametrize("name", ["overlap", "lcs", "lsum"])
def test_rouge_steps_hold_one_piece(name):
    udf = {"overlap": M._overlap_udf((1, 2), "clipped"), "lcs": M._rouge_l_udf, "lsum": M._rouge_lsum_udf}[name]
    side = pa.array([[t[:30]] for t in TOKENS] * 4 if name == "lsum" else [t[:30] for t in TOKENS] * 4)
    got = udf.func(side, side)
    assert len(got) == 4 * len(TOKENS) and set(got.field(0).to_pylist()) == ({30} if name == "overlap" else {1.0})
    assert peak_mb(udf.func(side, side) for _ in range(1)) < 10
    nothing = udf.func(pa.array([None, []], side.type), side.slice(0, 2))
    assert nothing.field(0).to_pylist() == [0, 0]
