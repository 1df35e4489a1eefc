"""The tiled matrix kernel against plain loops."""

import numpy as np
import pytest

from pairlab.operators import metrics as M


def brute(cand, ref):
    if not len(cand) or not len(ref):
        return 0.0, 0.0
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if a.any() and b.any() else 0.0
    return (float(np.mean([max(cos(a, b) for b in ref) for a in cand])), float(np.mean([max(cos(a, b) for a in cand) for b in ref])))


@pytest.mark.parametrize("tile", [1, 3, 1024])
def test_kernel(tile):
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 7), (10, 2), (0, 3), (3, 0)):
        a, b = rng.normal(size=(n, 4)), rng.normal(size=(m, 4))
        a[:1] = 0
        assert np.allclose(M.greedy_match(a, b, tile), brute(a, b))


def test_pairs_across_batches(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for p in [*range(40), None]:
        for lang in ("en", None):
            sides = [rng.normal(size=(rng.integers(0, 9), 3)) for _ in range(2)]
            if p == 7:
                sides = [rng.normal(size=(300, 3)), rng.normal(size=(200, 3))]  # one pair over many batches
            rows += [(p, lang, name, k, [float(x) for x in v]) for name, m in zip(("cand", "ref"), sides) for k, v in enumerate(m)]
            if len(sides[0]) or len(sides[1]):
                want[p, lang] = brute(*sides)
    rows += [(99, "en", "other", 0, [1.0, 2.0, 3.0]), (98, "en", "cand", 0, None), (98, "en", "ref", 0, [1.0, 0.0, 0.0])]
    want[99, "en"] = want[98, "en"] = (0.0, 0.0)
    df = spark.createDataFrame(rows, "p int, lang string, side string, pos int, embedding array<double>").repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(r.p, r.lang): (r.emb_p, r.emb_r) for r in M.embedding_match_score(df, ["p", "lang"], tile=16).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(got[k], v), k
    assert M.embedding_match_score(df.limit(0), ["p", "lang"]).count() == 0
