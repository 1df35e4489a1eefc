"""Operator 10: groups of near-equal and of merely similar lines, refined keys, rounds."""

import random

import pytest
from pyspark.sql import functions as F

import pairlab.llm.edit_line_dedup as E


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, line, n):
    s = list(line)
    for _ in range(n):
        at, kind = rng.randrange(len(s) + 1), rng.randint(0, 2)
        if kind == 0:
            s.insert(at, rng.choice("xyzé"))
        elif s:
            s[min(at, len(s) - 1):min(at, len(s) - 1) + 1] = [] if kind == 1 else [rng.choice("xyzé")]
    return "".join(s)


def brute(lines, distance):
    return {i for i, x in enumerate(lines) if any(abs(len(x) - len(y)) <= distance and edits(x, y) <= distance for y in lines[:i])}


@pytest.mark.parametrize("distance", [1, 2])
def test_similar_lines_share_a_key(spark, distance):
    rng = random.Random(distance)
    rows = []
    for _ in range(700):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(18, 90)))
        b = changed(rng, a, rng.randint(1, distance))
        if min(len(a), len(b)) >= 8:
            rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string")
    for keys in (lambda x: (lambda c: F.array(*E.segment_keys(x, c, distance))), lambda x: (lambda c: E.refined_keys(x, c, distance, 8)), lambda x: (lambda c: E.refined_keys(x, c, distance, 16))):
        shared = F.arrays_overlap(E.in_classes(F.col("a"), distance, keys(F.col("a"))), E.in_classes(F.col("b"), distance, keys(F.col("b"))))
        assert df.filter(~shared).count() == 0
    assert df.filter(F.bit_count(E.signature(F.col("a")).bitwiseXOR(E.signature(F.col("b")))) > 4 * distance).count() == 0


@pytest.mark.parametrize("refine_above", [4096, 30])
def test_templates_and_near_equal_groups(spark, monkeypatch, refine_above):
    """Lines of a template with long numbers hold one hot segment and few links; near-equal lines are all links."""
    monkeypatch.setattr(E, "REFINE_ABOVE", refine_above)
    rng = random.Random(4)
    lines = [f"the order with the number {rng.randrange(10 ** 7):07d} was sent to the customer" for _ in range(150)]
    lines += [changed(rng, lines[k], rng.randint(1, 3)) for k in range(0, 150, 5)]
    base = "a line of some length that stands in very many documents, nearly the same"
    lines += [changed(rng, base, rng.randint(0, 2)) for _ in range(150)]
    words = "every copy of this line has one other word in the place of one of its own".split()
    for _ in range(120):
        own = list(words)
        own[rng.randrange(len(own))] = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
        lines.append(" ".join(own))
    rng.shuffle(lines)
    lines = list(dict.fromkeys(lines))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r.doc_id for r in E.with_line_dedup(docs).filter("n_removed > 0").collect()}
    assert got == brute(lines, 2)


def test_internal_names_pass_through(spark):
    names = ["row", "doc", "pos", "place", "line", "h1", "h2", "r1", "r2", "f1", "f2", "first", "late", "body", "left", "key", "keys", "met", "a.b", "n_links"]
    docs = spark.createDataFrame([(1, "the same line in two documents"), (2, "the same line in two documents")], "doc_id bigint, text string")
    docs = docs.withColumns({n: F.lit(f"my {n}") for n in names}).withColumn("removed", F.lit("gives way"))
    out = E.with_line_dedup(docs)
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_removed", "removed"]
    assert {(r.doc_id, r.text, r["line"], r["a.b"], tuple(r.removed)) for r in out.collect()} == {
        (1, "the same line in two documents", "my line", "my a.b", ()), (2, "", "my line", "my a.b", (0,))}
