"""Periodic run detection by internal pattern matching (operator 13).

A run is a stretch of consecutive words with least period ``q`` and at least
``max(min_words, repeats * q)`` words that no neighbouring word extends.

The words of some texts, each text ended by a word of its own, are one sequence.

* Prefix doubling ranks all its substrings of 1, 2, 4, ... words; a rank is the place
  in the suffix array where the substring's class begins, so each class is a range of it.
* A run of period ``q`` in ``b .. 2b - 1`` (``b`` a power of two) holds a block of ``b``
  words at a multiple of ``b`` in its first ``2b - 1`` words, and the block occurs
  again ``q`` words later.  Each block asks for its occurrences in the window
  that begins ``b`` words later: a range successor query on a wavelet tree over the suffix array.
* Occurrences in such a window are a progression.  One or two are candidates as they
  are; of three or more, whose difference is a period of the block, only the one whose
  stretch of that period ends as the block's own does can be a period of the run.
* Each candidate is extended to both sides by the ranks (binary lifting), which
  decides it.  Stretches found with several periods keep the least.

Work is ``O(n log n)`` for ``n`` words, in numpy, ``block_words`` words at a time; a
longer text is a block of its own (its memory is some 100 bytes a word for each
doubling of its length).  Texts stay in their partitions: there is no shuffle.

Defined results: null, empty and blank texts have no words and no runs; repeated rows
are rows of their own; ties of length go to the smaller start, then period; an empty
table gives no rows; other columns pass through, those named like a result give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.packing import ROW, packed, unpacked
from pairlab.llm.registry import WORD, query, read

MIN_WORDS, REPEATS = 6, 4
BLOCK_WORDS = 1 << 17
OUT = ["n_words", "runs", "collapsed"]
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def substring_ranks(ids: np.ndarray, depth: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Ranks and class sizes of all substrings of 1, 2, 4, ... ``2 ** depth`` elements, and the suffix array to that depth.

    The last element of ``ids`` must be unique.
    """
    n = len(ids)
    count = np.bincount(ids)
    rank = (np.cumsum(count) - count)[ids]
    size = count[ids]
    ranks, sizes = [rank], [size]
    for k in range(depth):
        rank, size = rank.copy(), size.copy()
        open_ = np.flatnonzero(size > 1)
        if len(open_):
            after = open_ + (1 << k)
            next_ = np.where(after < n, ranks[-1][np.minimum(after, n - 1)] + 1, 0)
            key = rank[open_] * np.int64(n + 1) + next_
            order = np.argsort(key, kind="stable")
            key, at = key[order], open_[order]
            old = rank[at]
            place = np.arange(len(at))
            new_class = np.r_[True, key[1:] != key[:-1]]
            new_rank = np.r_[True, old[1:] != old[:-1]]
            first = np.maximum.accumulate(np.where(new_class, place, 0))
            base = np.maximum.accumulate(np.where(new_rank, place, 0))
            rank[at] = old + first - base
            starts = np.flatnonzero(new_class)
            size[at] = np.repeat(np.diff(np.r_[starts, len(at)]), np.diff(np.r_[starts, len(at)]))
        ranks.append(rank)
        sizes.append(size)
    return ranks, sizes, np.argsort(rank, kind="stable")


class WaveletTree:
    """Range counts and order statistics over a permutation, for arrays of queries."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []
        row = values
        for bit in range(self.bits - 1, -1, -1):
            one = (row >> bit) & 1
            self.zeros.append(np.r_[0, np.cumsum(1 - one)])
            row = np.r_[row[one == 0], row[one == 1]]

    def below(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the values at ``left .. right - 1`` are less than ``value``."""
        found = np.zeros(len(left), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            zl, zr, one = zeros[left], zeros[right], (value >> bit) & 1 == 1
            found += np.where(one, zr - zl, 0)
            left, right = np.where(one, zeros[-1] + left - zl, zl), np.where(one, zeros[-1] + right - zr, zr)
        return found

    def nth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest (from 0) of the values at ``left .. right - 1``."""
        found, k = np.zeros(len(left), np.int64), k.copy()
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            zl, zr = zeros[left], zeros[right]
            one = k >= zr - zl
            k -= np.where(one, zr - zl, 0)
            found |= np.where(one, 1 << bit, 0)
            left, right = np.where(one, zeros[-1] + left - zl, zl), np.where(one, zeros[-1] + right - zr, zr)
        return found


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, ahead: bool) -> np.ndarray:
    """Length of the common stretch that starts at (or, not ``ahead``, ends before) each ``a`` and ``b``, ``a < b``."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step, rank = 1 << k, ranks[k]
        moving = np.arange(len(a))
        while len(moving):  # once, but for the top level
            x, y = (a[moving] + length[moving], b[moving] + length[moving]) if ahead else (a[moving] - length[moving] - step, b[moving] - length[moving] - step)
            inside = x >= 0
            equal = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
            moving = moving[equal]
            length[moving] += step
            if k < len(ranks) - 1:
                break
    return length


def find_runs(ids: np.ndarray, longest: int, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of ``ids``, whose texts of at most ``longest`` words end in unique elements.

    ``repeats`` must be 4 or more: a block and its next occurrence have to lie in the run.
    """
    depth = max(0, (longest // repeats).bit_length() - 1)
    ranks, sizes, suffixes = substring_ranks(ids, depth)
    tree = WaveletTree(suffixes)
    n, starts, periods = len(ids), [], []
    for k in range(depth + 1):
        b = 1 << k
        s = np.arange(0, n - b + 1, b)
        s = s[sizes[k][s] > 1]
        left, right = ranks[k][s], ranks[k][s] + sizes[k][s]
        low = tree.below(left, right, np.minimum(s + b, n))
        high = tree.below(left, right, np.minimum(s + 2 * b, n))
        hit = high > low
        s, left, right, low, high = s[hit], left[hit], right[hit], low[hit], high[hit]
        first, last, m = tree.nth(left, right, low), tree.nth(left, right, high - 1), high - low
        few = m <= 2
        starts += [s[few], s[m == 2]]
        periods += [first[few] - s[few], last[m == 2] - s[m == 2]]
        s, first, last, m = s[~few], first[~few], last[~few], m[~few]
        if len(s):
            step = (last - first) // (m - 1)
            own = step + _common(ranks, s, s + step, True)  # the stretch of this period from the block on
            there = first + step + _common(ranks, first, first + step, True)
            at = there - own
            fits = (at >= first) & (at <= last)
            starts.append(s[fits])
            periods.append(at[fits] - s[fits])
    s, q = np.concatenate(starts), np.concatenate(periods)
    start = s - _common(ranks, s, s + q, False)
    end = s + q + _common(ranks, s, s + q, True)
    whole = end - start >= np.maximum(min_words, repeats * q)
    start, end, q = start[whole], end[whole], q[whole]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, q = start[least], end[least], q[least]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _judged(texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], np.ndarray | None]]:
    """Runs of each text as (start, length, period), and which words stay (None: all)."""
    out: list = [([], None) for _ in texts]
    used = [i for i, words in enumerate(texts) if len(words) >= MIN_WORDS]
    if not used:
        return out
    lengths = np.array([len(texts[i]) for i in used])
    ends = np.cumsum(lengths + 1)
    flat = np.empty(ends[-1], object)
    is_word = np.ones(ends[-1], bool)
    is_word[ends - 1] = False
    flat[is_word] = [w for i in used for w in texts[i]]
    ids = np.empty(ends[-1], np.int64)
    ids[is_word], words = pd.factorize(flat[is_word])
    ids[~is_word] = len(words) + np.arange(len(used))
    start, end, period = find_runs(ids, int(lengths.max()))
    begins = ends - lengths - 1
    of = np.searchsorted(begins, start, "right") - 1
    for t in np.unique(of):
        mine = of == t
        s, e, q = start[mine] - begins[t], end[mine] - begins[t], period[mine]
        change = np.zeros(lengths[t] + 1, np.int64)
        np.add.at(change, s + q, 1)
        np.add.at(change, e, -1)
        out[used[t]] = (list(zip(s.tolist(), (e - s).tolist(), q.tolist())), np.cumsum(change)[:-1] == 0)
    return out


def with_runs(docs: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period) and the ``collapsed`` text.

    A word goes if any run holds it after that run's first period; the others are joined by spaces.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found: list = []
            begin, held = 0, 0
            for i, words in enumerate(texts):
                if held and held + len(words) > block_words:
                    found += _judged(texts[begin:i])
                    begin, held = i, 0
                held += len(words)
            found += _judged(texts[begin:])
            left = [b" ".join(w if k is None else [x for x, y in zip(w, k.tolist()) if y]) for w, (_, k) in zip(texts, found)]
            kinds = kinds or pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs, _ in found], kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in texts], pa.int64()), runs, pa.array(left, pa.binary()).cast(pa.string())],
                names=[ROW, *OUT])

    rows = packed(docs, text=F.col(text).cast("string"))
    schema = T.StructType([rows.schema[ROW]]).add("n_words", T.LongType()).add("runs", RUNS).add("collapsed", T.StringType())
    return unpacked(rows.mapInArrow(work, schema), docs.columns, OUT)


def periodic_text(text: Column, doc_id: Column) -> Column:
    """The contract's texts: from word ``a`` on, one of ten documents repeats its next ``p`` words."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        at = F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p"))
        new = lambda t: F.transform(words, lambda w, i: F.when(i < t["a"], w).otherwise(F.get(words, (t["a"] + (i - t["a"]) % t["p"]).cast("int"))))
        return F.when(n > 0, F.array_join(F.element_at(F.transform(F.array(at), new), 1), " ")).otherwise(F.lit(""))

    words = F.array(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)))
    return F.when(h % 10 == 0, F.element_at(F.transform(words, repeated), 1)).otherwise(text)


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", periodic_text(F.col("text"), F.col("doc_id")).alias("text"))
    runs = F.col("runs")
    longest = F.reduce(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
                       lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = with_runs(docs).select(
        "doc_id", F.size(runs).cast("bigint").alias("n_runs"), longest.alias("best"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
