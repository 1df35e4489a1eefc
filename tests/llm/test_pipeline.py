"""The pipeline on a driver table, stage by stage against brute force."""

import re

import corpus_pipeline as P
from pairlab.llm.registry import read
from tests.conftest import SF_SMALL
from tests.llm.test_operators import ODD, components, edits, fingerprint, quality, words5

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def parts(line):
    """A third of the line at either end, and all of that size about the middle."""
    n = max(1, (len(line) - 4) // 3)
    for size in range(max(1, n - 1), n + 1):
        yield from ((0, line[:size]), (1, line[-size:]))
        for at in range(max(0, len(line) // 3 - 6), len(line) // 3 + 7):
            yield 2, line[at:at + size]


def near_lines(line, thirds):
    return {x for p in parts(line) for x in thirds.get(p, ()) if abs(len(x) - len(line)) <= 2} if len(line) >= 20 else ()


def remember(line, lines, thirds):
    if line not in lines:
        lines.add(line)
        if len(line) >= 20:
            for p in parts(line):
                thirds.setdefault(p, []).append(line)


def test_line_dedup_takes_two_edits_and_equal_short_lines(spark):
    texts_ = ["The meeting of the year 2019 took place\nLes.\nfirst", "The meeting of the year 2021 took place\nLes.\nsecond", "The meeting of the year 2234 took place\n \nfirst"]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts_)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = texts(P.line_dedup(spark, docs, ""))
    assert got == {0: texts_[0], 1: "second", 2: "The meeting of the year 2234 took place\n "}


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]
    docs = read(spark, SF_SMALL, "documents")
    before = texts(docs)
    good = P.quality_rules(spark, docs, SF_SMALL).checkpoint()
    assert good.columns == docs.columns
    kept = texts(good)
    for i, t in before.items():
        q = quality(t)
        assert i not in kept or (q[0] >= 50 and 100 * q[4] <= 50 * q[0] and kept[i] == t)

    lined = P.line_dedup(spark, good, SF_SMALL).checkpoint()
    assert lined.schema == good.schema
    after = texts(lined)
    seen, lines, thirds = [], set(), {}
    for i in sorted(kept):  # in order of first occurrence
        left = []
        for line in kept[i].split("\n"):
            if not WORDS.search(line):
                left.append(line)
            elif line in lines or any(edits(x, line) <= 2 for x in near_lines(line, thirds)):
                remember(line, lines, thirds)
            else:
                remember(line, lines, thirds)
                left.append(line)
        text = "\n".join(left)
        if WORDS.search(text) or text == kept[i]:
            seen.append(i)
            assert after[i] == text
    assert sorted(after) == seen
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    near = texts(P.simhash_near_dedup(spark, lined, SF_SMALL))
    ids = sorted(after)
    want = components([fingerprint(after[i]) for i in ids], ids, 4)
    assert near == {i: after[i] for k, i in enumerate(ids) if want[k] == i}

    clean = P.decontamination(spark, lined, SF_SMALL).checkpoint()
    grams = {}
    for r in read(spark, SF_SMALL, "benchmark").collect():
        w = words5(r.text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            grams.setdefault(n, set()).add(tuple(w[k:k + n]))
    dirty = {i for i, t in after.items() if any(tuple(w[k:k + n]) in g for w in [words5(t)] for n, g in grams.items() for k in range(len(w) - n + 1))}
    assert sorted(texts(clean)) == sorted(set(after) - dirty)

    mixed = P.mixing(spark, clean, SF_SMALL).collect()
    assert all(r.taken == r["size"] * r.repeats > 0 and r.text == after[r.doc_id] for r in mixed)


def test_odd_rows_pass_every_stage(spark):
    docs = spark.createDataFrame([(d, t, "en", s, "x") for d, t in ODD for s in ("a", None)],
                                 "doc_id bigint, text string, lang string, source string, component string")
    docs = docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) n_chars", "component", "component as kept", "component as size")
    for rows in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, rows, SF_SMALL)
            assert out.columns[:len(docs.columns) - 1] == docs.columns[:-1], name
            out.collect()
    assert P.line_dedup(spark, docs, SF_SMALL).count() == docs.count()
    assert P.decontamination(spark, docs, SF_SMALL).count() == docs.count()


def test_run(spark):
    out = P.run(spark, SF_SMALL)
    assert out.count() > 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
