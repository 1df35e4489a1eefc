"""Quality rules by repetition coverage (operator 4).

Rolling hashes of several n-gram lengths, in numpy, find the n-grams that a
text holds more than once; coverage is the number of characters of the words
inside such n-grams (and of the repeated lines), each counted once.  Equal
hashes are confirmed on the words themselves, so the numbers are exact.  Each
text is measured in its own row: no shuffle, memory bounded by one text.

Defined results: a null text has no words and no lines; an empty or blank text
likewise (``n_words`` 0, so it fails the base rule); repeated rows and rows with
equal or null ids are measured one by one; other columns pass through
untouched, a column called like an output is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.packing import packed, unpacked
from pairlab.llm.registry import WORD, query, read

# fixed values of the base rules
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_NGRAM = 3
MAX_REPEAT_PERCENT = 50

# the method's rules: n-gram length -> most percent of word characters inside
# n-grams that occur twice or more; the same for repeated lines, and the most
# symbols for 100 words
MAX_GRAM_PERCENT = {5: 35, 7: 30, 10: 25}
MAX_LINE_PERCENT = 30
MAX_SYMBOLS_PER_100_WORDS = 25

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
          *(f"dup_gram_chars_{n}" for n in MAX_GRAM_PERCENT)]
MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in FIELDS])

_word = re.compile(WORD)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread small integers over 64 bits."""
    x = x.astype(np.uint64) + _BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_windows(ids: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each n-word window, whether another window holds the same words."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    equal = np.flatnonzero(ranked[1:] == ranked[:-1])
    found = np.zeros(len(hashes), bool)
    if not len(equal):
        return found
    a, b = order[equal], order[equal + 1]
    if all(np.array_equal(ids[a + k], ids[b + k]) for k in range(n)):
        found[a] = found[b] = True
        return found
    windows = np.lib.stride_tricks.sliding_window_view(ids, n)  # a hash collision: compare the words
    _, group, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    return count[group.ravel()] > 1


def covered(windows: np.ndarray, n: int, size: int) -> np.ndarray:
    """The words inside any of the marked windows."""
    edge = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(windows)
    edge[at] += 1
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge[:size]) > 0


def measure(text: str | None) -> tuple[int, ...]:
    """The values of ``FIELDS`` for one whole text."""
    text = text or ""
    words = _word.findall(text)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    seen: set[str] = set()
    n_dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += sum(map(len, _word.findall(line)))
        elif _word.search(line):
            seen.add(line)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    mixed = _mix(ids)
    hashes = mixed.copy()
    chars: dict[int, int] = {}
    n_repeat_words = 0
    for n in range(2, max(MAX_GRAM_PERCENT) + 1):
        hashes = hashes[:-1] * _BASE + mixed[n - 1:]
        if not len(hashes):
            break
        if n == REPEAT_NGRAM or n in MAX_GRAM_PERCENT:
            inside = covered(repeated_windows(ids, hashes, n), n, len(ids))
            if n == REPEAT_NGRAM:
                n_repeat_words = int(inside.sum())
            if n in MAX_GRAM_PERCENT:
                chars[n] = int(sizes[inside].sum())
    return (len(words), int(sizes.sum()), sum(map(text.count, SYMBOLS)), n_dup_lines, n_repeat_words,
            dup_line_chars, *(chars.get(n, 0) for n in MAX_GRAM_PERCENT))


@F.pandas_udf(MEASURES)
def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=FIELDS, dtype="int64")


def with_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``; one row in, one row out."""
    out = packed(docs, text=F.col(text)).select("row", measures("text").alias("m")).select("row", *(F.col(f"m.{c}").alias(c) for c in FIELDS))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    worse = 100 * F.col("dup_line_chars") > MAX_LINE_PERCENT * F.col("word_chars")
    worse = worse | (100 * F.col("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * F.col("n_words"))
    for n, most in MAX_GRAM_PERCENT.items():
        worse = worse | (100 * F.col(f"dup_gram_chars_{n}") > most * F.col("word_chars"))
    return unpacked(out.withColumn("base_failed", base).withColumn("kept", ~base & ~worse), docs.columns, [*FIELDS, "base_failed", "kept"])


def _sql() -> str:
    lead = {n: " || ' ' || ".join(["w"] + [f"lead(w, {k}) over o" for k in range(1, n)]) for n in
            {REPEAT_NGRAM, *MAX_GRAM_PERCENT}}
    grams = ", ".join(f"{e} as g{n}" for n, e in lead.items())
    counts = ", ".join(f"g{n} is not null and count(*) over (partition by doc_id, g{n}) > 1 as d{n}" for n in lead)
    inside = ", ".join(f"bool_or(d{n}) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as c{n}" for n in lead)
    tests = " or ".join(f"100 * dup_gram_chars_{n} > {m} * word_chars" for n, m in MAX_GRAM_PERCENT.items())
    sums = ", ".join(f"coalesce(sum(length(w)) filter (where c{n}), 0) as dup_gram_chars_{n}" for n in MAX_GRAM_PERCENT)
    word = r"[^\x20\x09-\x0D]+"
    return f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
w0 as (select doc_id, unnest(regexp_extract_all(text, '{word}')) as w,
              generate_subscripts(regexp_extract_all(text, '{word}'), 1) as i from docs),
w1 as (select doc_id, w, i, {grams} from w0 window o as (partition by doc_id order by i)),
w2 as (select doc_id, w, i, {counts} from w1),
w3 as (select doc_id, w, {inside} from w2),
words as (select doc_id, count(*) as n_words, sum(length(w)) as word_chars,
                 count(*) filter (where c{REPEAT_NGRAM}) as n_repeat_words, {sums} from w3 group by doc_id),
l0 as (select doc_id, unnest(string_split(text, chr(10))) as line,
              generate_subscripts(string_split(text, chr(10)), 1) as i from docs),
l1 as (select doc_id, line, row_number() over (partition by doc_id, line order by i) as r from l0
       where regexp_matches(line, '{word}')),
lines as (select doc_id, count(*) as n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) as dup_line_chars
          from l1 where r > 1 group by doc_id),
m as (select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
             coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
             coalesce(dup_line_chars, 0) as dup_line_chars,
             {", ".join(f"coalesce(dup_gram_chars_{n}, 0) as dup_gram_chars_{n}" for n in MAX_GRAM_PERCENT)}
      from docs d left join words using (doc_id) left join lines using (doc_id)),
v as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
             100 * dup_line_chars > {MAX_LINE_PERCENT} * word_chars
             or 100 * n_symbols > {MAX_SYMBOLS_PER_100_WORDS} * n_words or {tests} as worse from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and not worse as kept from v"""


@query("op4_quality_rules", _sql())
def op4_quality_rules(spark, sf_dir):
    return with_quality(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
