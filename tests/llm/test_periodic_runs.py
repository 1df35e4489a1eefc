"""Operator 13 against a brute-force search for runs."""

import hashlib
import random
import zlib

import pytest

import pairlab.llm.periodic_runs as P
from pairlab.llm.registry import QUERIES


def brute(words):
    n, spans = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                spans.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in spans.items())


def collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = []
    for _ in range(1500):
        letters = rng.choice(["a", "ab", "abc", "abcdefgh"])
        words = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        while rng.random() < 0.6:
            at, p = rng.randint(0, len(words)), rng.randint(1, 12)
            piece = [rng.choice(letters) for _ in range(p)]
            words[at:at] = (piece * rng.randint(2, 9))[: rng.randint(2, 80)]
        texts.append([w.encode() for w in words])
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    texts += [list(map(chr, fib[-1])), [b"x"] * 300, ([b"x"] * 7 + [b"y"]) * 40, (([b"x", b"y"] * 9 + [b"z"]) * 6 + [b"w"]) * 5]
    texts = [[w if isinstance(w, bytes) else w.encode() for w in t] for t in texts]
    for size in (1, 7, len(texts)):  # texts in blocks of their own and together
        part = texts if size > 1 else texts[-40:]
        for k in range(0, len(part), size):
            for words, (runs, kept) in zip(part[k:k + size], P._judged(part[k:k + size])):
                assert runs == brute(words)
                assert [w for i, w in enumerate(words) if kept is None or kept[i]] == collapsed(words, runs)


def test_wavelet_tree():
    import numpy as np
    rng = np.random.default_rng(1)
    values = rng.permutation(100)
    tree = P.WaveletTree(values)
    left, right = rng.integers(0, 50, 200), rng.integers(51, 101, 200)
    x = rng.integers(0, 101, 200)
    assert tree.below(left, right, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(left, right, x)]
    assert tree.nth(left, right, np.zeros(200, int) + 1).tolist() == [int(np.sort(values[a:b])[1]) for a, b in zip(left, right)]


def test_rows_of_all_kinds(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, " \t\n", "k"), (4, "a b c", "k"), (None, "x x x x x x x y", "k"), (5, "é é  é é\té é", "k"), (5, "é é  é é\té é", "k"),
            (6, " ".join(["u v w"] * 50000), "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string").withColumns({"runs": P.F.lit(1), "__text": P.F.lit(2)})
    out = P.with_runs(docs, block_words=100)
    assert out.columns == ["doc_id", "text", "row", "__text", "n_words", "runs", "collapsed"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert sorted(got, key=str) == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 3, [], "a b c"), (None, 8, [(0, 7, 1)], "x y"),
        (5, 6, [(0, 6, 1)], "é"), (5, 6, [(0, 6, 1)], "é"), (6, 150000, [(0, 150000, 3)], "u v w")], key=str)
    assert out.filter("row <> 'k'").count() == 0
    assert P.with_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_runs for r in got) > 0
    for r in got:
        words = [w.decode() for w in (docs[r.doc_id] or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words) if n < 1500 else None
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_runs, (r.start, r.length, r.period)) == (len(runs), best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == digest("".join(f"{s},{k},{q}\n" for s, k, q in runs))
        assert r.collapsed_sha256 == digest(" ".join(collapsed(words, runs)))
