"""Operator 11 against brute-force counts."""

import random
import re
from collections import Counter

import pytest

import pairlab.llm.collocations as C
from pairlab.llm.registry import QUERIES


def brute(rows, least, longest=5):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, p, a, counts[p[:k]], counts[p[k:]], n[lang], score))
    return sorted(out)


def made(seed, size=150):
    rng = random.Random(seed)
    words = ["a", "b", "a\x01", "the", "é", "zu", "x\x1f", "of", "ab"]
    fixed = ["in order to be sure", "New York", "a a a a a a", "once upon a time there"]
    rows = [("en", None), (None, ""), ("en", " \t.;\n")]
    for _ in range(size):
        parts = []
        for _ in range(rng.randint(1, 12)):
            parts.append(rng.choice(fixed) if rng.random() < 0.5 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", "\t", ". ", ", ", "\n", "  ", "\x0b"]))
        rows.append((rng.choice(["en", "en", "fr", None]), "".join(parts)))
    return rows


@pytest.mark.parametrize("seed, least, bits, parts", [(1, 5, 25, 8), (2, 3, 25, 40), (3, 8, 4, 3)])
def test_phrases_equal_brute_force(spark, seed, least, bits, parts, monkeypatch):
    rows = made(seed)
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({"phrase": C.F.lit("mine"), "f": C.F.lit(1)})
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many partitions of the streams
    monkeypatch.setattr(C, "BLOCK_BYTES", 200)
    try:
        got = C.collocations(docs, least=least, word_bits=bits, pair_bits=bits).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r.lang, tuple(r.phrase), r.a, r.l, r.r, r.n, r.score) for r in got) == brute(rows, least)


def test_phrases_are_named_about_once(spark, monkeypatch):
    """Rows that hold a phrase's words go with the phrases, not with the blocks that hold them."""
    rng = random.Random(4)
    rows = [("en", f"t{i} " + " ".join(rng.choices("abc", k=14))) for i in range(4000)]
    docs, made = spark.createDataFrame(rows, "lang string, text string").repartition(40), []
    real = type(docs).mapInArrow

    def counted(self, work, schema, *more):
        out = real(self, work, schema, *more)
        if self.columns == ["lang", "text"] and "phrase" in str(schema):
            made.append(out.count())
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    found = C.frequent_phrases(docs).filter("size(phrase) > 1")
    want = often(rows, 100)
    assert {(r.lang, tuple(r.phrase)): r.f for r in found.collect()} == want
    assert sum(made) <= 10 * len(want)


def often(rows, least):
    """Frequent phrases of 2 to 5 words of texts without piece ends."""
    f = Counter()
    for lang, text in rows:
        words = text.split()
        f.update((lang, tuple(words[i:i + k])) for k in range(2, 6) for i in range(len(words) - k + 1))
    return {p: a for p, a in f.items() if a >= least}


@pytest.mark.parametrize("longest", [2, 3, 4, 5])
def test_longest(spark, longest):
    """A phrase that only one text holds is named in whichever round that text falls."""
    rows = made(5) + [("de", "nur hier steht das " * 9)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = C.collocations(docs, least=5, longest=longest).collect()
    assert sorted((r.lang, tuple(r.phrase), r.a, r.l, r.r, r.n, r.score) for r in got) == brute(rows, 5, longest)


def test_products_beyond_64_bits():
    row = {"lang": "en", "phrase": ["a", "b"], "f": 10 ** 15, "left": [10 ** 18, 10 ** 16], "covered": False}
    assert C._scored(row, [10 ** 18, 10 ** 17], False)["score"] == 1000 * 10 ** 33 // 10 ** 33


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, every = [], brute(rows, 100)
    for lang in {x[0] for x in every}:
        mine = sorted((x for x in every if x[0] == lang), key=lambda x: (-x[6], -x[2], " ".join(x[1]).encode()))[:2000]
        want += [(lang, i + 1, " ".join(x[1]), *x[2:]) for i, x in enumerate(mine)]
    assert sorted(tuple(r) for r in QUERIES["op11_collocations"](spark, sf).collect()) == sorted(want)
