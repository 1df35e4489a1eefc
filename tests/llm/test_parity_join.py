"""Operator 12 against a brute-force Jaccard join."""

import random
import re

import numpy as np
import pytest

import pairlab.llm.parity_join as J
from pairlab.llm.registry import QUERIES


def shingles(text, k=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    ids = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, len(sets[i]), ids[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def made(seed, n=260):
    """Groups of copies with ever more words changed, chains, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    passage = [word() for _ in range(60)]
    texts = ["", None, " \n", "one", "ONE", "one two", "one two three", "one two three four", "One  two three\nfour"]
    while len(texts) < n:
        base = [word() for _ in range(rng.choice([3, 5, 8, 20, 60, 150, 400]))]
        if rng.random() < 0.3:
            base[rng.randint(0, len(base)):0] = passage
        for _ in range(rng.randint(1, 14)):
            texts.append(" ".join(base))
            if rng.random() < 0.5:  # a chain: the next copy is made of this one
                base = list(base)
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 60)):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
                if not copy:
                    copy = [word()]
            base = copy
    rng.shuffle(texts)
    return [(None if i % 50 == 49 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, tile, nearest", [(1, 1024, 16), (2, 4, 2), (3, 16, 2)])
def test_components_equal_brute_force(spark, seed, tile, nearest):
    rows = made(seed)
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", J.F.lit("mine")).withColumn("h1", J.F.lit(1))
    got = sorted((tuple(r) for r in J.similar_components(docs, tile=tile, nearest=nearest).collect()), key=str)
    assert got == brute(rows)


def test_keys_with_the_same_nodes_are_compared_once(spark, tmp_path, monkeypatch):
    """Rows that carry sketches: each node once a key, no two keys with the same nodes, later rounds only where pairs are left."""
    monkeypatch.setattr(J, "scratch_path", lambda *_: str(tmp_path / "parity"))
    rows = made(1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in J.similar_components(docs, nearest=2).collect()), key=str)
    assert got == brute(rows)
    held = {}
    for r in spark.read.parquet(str(tmp_path / "parity" / "spread0")).collect():
        held.setdefault(r.key, []).append(r.node)
    assert held and all(len(set(nodes)) == len(nodes) for nodes in held.values())
    assert len({tuple(sorted(nodes)) for nodes in held.values()}) == len(held)
    further = {r.a for r in spark.read.parquet(str(tmp_path / "parity" / "near0")).filter("a = b").collect()}
    if (tmp_path / "parity" / "spread1").exists():
        later = {}
        for r in spark.read.parquet(str(tmp_path / "parity" / "spread1")).collect():
            later.setdefault(r.key, set()).add(r.node)
        assert all(nodes & further for nodes in later.values())


def test_rows_that_get_labels_are_those_of_distinct_keys(spark, tmp_path, monkeypatch):
    """Labels are joined once a round, to the rows of keys that differ in their nodes, later only of keys with several components."""
    monkeypatch.setattr(J, "scratch_path", lambda *_: str(tmp_path / "parity"))
    rows = made(2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in J.similar_components(docs, nearest=2).collect()), key=str)
    assert got == brute(rows)

    def nodes(name):
        held = {}
        for r in spark.read.parquet(str(tmp_path / "parity" / name)).collect():
            held.setdefault(r.key, []).append((r.node, r.lower))
        return {k: tuple(sorted(v)) for k, v in held.items()}
    every, first = nodes("members"), nodes("tagged0")
    assert len(first) == len(set(every.values())) < len(every) and set(first.values()) == set(every.values())
    times = {r.key: r.times for r in spark.read.parquet(str(tmp_path / "parity" / "distinct")).collect()}
    assert sum(times.values()) == len(every)
    parts = {}
    for r in spark.read.parquet(str(tmp_path / "parity" / "tagged0")).collect():
        parts.setdefault(r.key, set()).add(r.component)
    assert (tmp_path / "parity" / "tagged1").exists() and set(nodes("tagged1")) == {k for k, v in parts.items() if len(v) > 1}


def test_pair_beyond_the_nearest_is_found_from_either_side():
    """A pair is left by one node as too far down its list, and then given by the other, which lay in the largest component before."""
    spots = lambda *at: np.packbits(np.isin(np.arange(64), at)).tobytes()
    node, size, tile = np.arange(4), np.full(4, 100), np.zeros(4, int)
    sketches = [spots(), spots(1, 2), spots(1, 3), spots(4, 5, 6)]
    first = J._near_pairs(node, np.array([0, 0, 0, 3]), size, tile, sketches, 85, 1)
    assert (3, 3) in first
    later = J._near_pairs(node, np.array([0, 1, 1, 1]), size, tile, sketches, 85, 4)
    assert {(0, 1), (0, 2), (0, 3)} <= set(later)


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(7, 900))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        d = J.difference_bound(n, n)
        out = int(rng.integers(0, d + 1))
        b = np.unique(np.r_[a[out:], rng.integers(0, 1 << 63, d - out, dtype=np.uint64)])
        inter = len(np.intersect1d(a, b))
        if 100 * inter < 85 * (len(a) + len(b) - inter) or np.array_equal(a, b):
            continue
        (a0, a1), (b0, b1) = J.sketch_keys(a), J.sketch_keys(b)
        assert set(np.r_[a0, a1]) & set(np.r_[b0, b1])


def test_sketch_distance_bounds_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        b = np.unique(np.r_[a[50:], rng.integers(0, 1 << 63, 40, dtype=np.uint64)])
        x, y = (np.frombuffer(J.small_sketch(s, 5), np.uint8) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_groups_across_batches():
    import pyarrow as pa
    key = [1, 2, 2, 2, 3, 3, 5, 5]
    low = J._LOWER_BAND
    mark = [9, 4, 7, low + 1, low + 3, low + 4, 6, 8]
    want = {(2, 4, False, 4), (2, 7, False, 4), (2, 1, True, 4), (5, 6, False, 6), (5, 8, False, 6)}
    for size in (1, 2, 3, 8):
        parts = [pa.RecordBatch.from_arrays([pa.array(key[i:i + size], pa.int64()), pa.array(mark[i:i + size], pa.int64())], names=["key", "mark"]) for i in range(0, 8, size)]
        got = [tuple(r.values()) for b in J._groups(iter(parts)) for r in b.to_pylist()]
        assert set(got) == want and len(got) == len(want)


def test_empty_table(spark):
    assert J.similar_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_parity_join"](spark, sf).collect()), key=str) == brute(rows)
