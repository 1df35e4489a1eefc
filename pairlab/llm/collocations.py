"""Phrase collocations from count streams in prefix and suffix order (operator 11).

Phrases are 2 to ``longest`` words in a row within a piece of a text; per language
those found ``least`` times or more are scored by their weakest cut
``floor(1000 * a * n / (l * r))`` and dropped where a longer phrase is as frequent.

* Every phrase of a frequent phrase is frequent.  Words are counted first, then hashes of pairs of
  frequent words, of triples of frequent pairs, and of longer phrases all of whose triples are frequent.
  Blocks of texts count their own equal hashes before anything is shuffled.  "Frequent" is asked of bitmaps of
  bounded size (``hash_filter``), which may let some others through: they cost a row and fail the count.
* A phrase found ``least`` times or more is then named (its words read from a text) once: a small share of the
  texts gives names first, ever larger ones give those still missing, the last share all that
  are left.  The rows so made go with the phrases, not with the blocks that hold them.
* A phrase stands for its 64-bit hash in the counts (as shingles do in operators 7 and 12), words for themselves.
* The frequent phrases, with the empty phrase for a language's ``n``, are one stream in
  prefix order (words from the left), dealt to partitions by range.  There
  a phrase stands after all its beginnings, so a stack of at most ``longest`` counts
  gives the count of each left part; and a phrase whose one-word extension is as frequent
  has no other extension, so that the next row of the stream tells it.
* The same stream, now with its left counts, is put in suffix order (words from the
  right), where the stack gives the counts of the right parts, and the next row the extension to
  the left.  Both passes read rows in step; there is no join and no hash table of phrases.
* What a partition needs from its neighbours (the beginnings of its first row, and the row after its last)
  is at most ``longest + 1`` rows a partition, found by an exact join.

Scores are Python integers, so products of any size are exact.

Defined results: a null language is ``und``; null and empty texts hold no words; repeated rows
count again; ties of score and count are in byte order of the phrase; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlab.llm.hash_filter import BITS, bitmap_of, may_hold, mixed
from pairlab.llm.registry import query, read
from pairlab.session import cut_lineage

LEAST, LONGEST, TOP = 100, 5, 2000
PAIR_BITS = BITS + 2
SHARES = (0, 2, 16, 256)  # of 256 parts of the texts: where the rounds of naming begin and end
BLOCK_BYTES = 4 << 20  # of text counted at once
# lower case, piece ends as line feeds, tabs as spaces
TABLE = bytes(10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
STREAM = "lang string, phrase array<string>, f bigint"
NAMES = "lang string, phrase array<string>, hash bigint"


def word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, text) -> for each language of a block of texts: distinct words, word codes in order, and how many words of the piece are left."""
    for batch in batches:
        blocks: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}
        for lang, scalar in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):  # texts one by one: not the batch twice
            text = scalar.as_py()
            if not text:
                continue
            if held.get(lang, 0) > BLOCK_BYTES:
                yield lang, *_coded(blocks.pop(lang))
                held[lang] = 0
            blocks.setdefault(lang, []).append(text)
            held[lang] = held.get(lang, 0) + len(text)
        for lang, some in blocks.items():
            yield lang, *_coded(some)


def _coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = b"\n".join(texts).translate(TABLE)
    words = data.split()
    each = np.empty(len(words), object)
    each[:] = words
    del words
    codes, names = pd.factorize(each)
    del each
    byte = np.frombuffer(data, np.uint8)
    blank = (byte == 32) | (byte == 10)
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]][: len(byte)])
    piece = np.cumsum(byte == 10, dtype=np.int32)[start]
    end = np.searchsorted(piece, piece, "right")
    return names, codes, end - np.arange(len(codes))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, names, codes, _ in word_blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names.tolist(), pa.binary()).cast(pa.string()),
                                          pa.array(np.bincount(codes, minlength=len(names)))], names=["lang", "word", "f"])


def _phrases(lang: str, names: np.ndarray, codes: np.ndarray, left: np.ndarray, maps: Sequence[np.ndarray],
             longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The block's phrases of 2, 3, ... words, as far as the bitmaps (of words, pairs, ...) hold their parts:
    how many words, hashes, times found, where one begins, and which one that is."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)  # as Spark's xxhash64(lang, word)
    hashes, number = np.array([xxhash.xxh64_intdigest(w, seed) for w in names], np.uint64), codes
    on = may_hold(maps[0], hashes)[codes] if len(codes) else np.zeros(0, bool)
    for size in range(2, longest + 1):
        both = np.zeros(len(codes), bool)
        both[:-1] = on[:-1] & on[1:]
        at = np.flatnonzero(both & (left >= size))
        n = max(1, len(hashes))
        each, which, times = np.unique(number[at] * np.int64(n) + number[at + 1], return_inverse=True, return_counts=True)
        hashes = mixed(mixed(hashes[each // n]) + hashes[each % n])
        yield size, hashes, times, at, which
        on = np.zeros(len(codes), bool)
        on[at] = may_hold(maps[size - 1], hashes)[which] if size <= len(maps) else True
        number = np.zeros(len(codes), np.int64)
        number[at] = which


def _count_phrases(maps: Sequence[np.ndarray], shortest: int, longest: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in word_blocks(batches):
            for size, hashes, times, _, _ in _phrases(*block, maps, longest):
                if size >= shortest:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times.astype(np.int64))], names=["hash", "f"])
    return work


def _name_phrases(maps: Sequence[np.ndarray], wanted: np.ndarray, longest: int) -> Callable:
    """The words of the phrases whose hashes ``wanted`` holds, once a block."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, codes, left in word_blocks(batches):
            for size, hashes, _, at, which in _phrases(lang, names, codes, left, maps, longest):
                where = np.zeros(len(hashes), np.int64)
                where[which] = at
                kept = may_hold(wanted, hashes)
                places = where[kept, None] + np.arange(size)
                words = pa.array(names[codes[places.ravel()]].tolist(), pa.binary()).cast(pa.string())
                offsets = pa.array(np.arange(len(places) + 1, dtype=np.int32) * np.int32(size))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(places), pa.string()), pa.ListArray.from_arrays(offsets, words),
                                                  pa.array(hashes[kept].view(np.int64))], names=["lang", "phrase", "hash"])
    return work


def _bitmap(rows: DataFrame, column: Column, bits: int) -> np.ndarray:
    """A bitmap of at least 256 bits a row, as far as ``2 ** bits`` go."""
    return bitmap_of(rows, column, min(bits, (256 * rows.count()).bit_length()))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                     word_bits: int = BITS, pair_bits: int = PAIR_BITS) -> DataFrame:
    """``(lang, phrase, f)`` of all phrases found ``least`` times or more, and the empty phrase with the number of words."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    total = F.sum("f").alias("f")
    words = cut_lineage(rows.mapInArrow(_count_words, "lang string, word string, f bigint").groupBy("lang", "word").agg(total))
    all_ = words.groupBy("lang").agg(total).select("lang", F.array().cast("array<string>").alias("phrase"), "f")
    words = words.filter(F.col("f") >= least)
    word_map = _bitmap(words, F.xxhash64("lang", "word"), word_bits)

    def often(maps: Sequence[np.ndarray], shortest: int, longest: int) -> DataFrame:
        counts = rows.mapInArrow(_count_phrases(maps, shortest, longest), "hash bigint, f bigint").groupBy("hash").agg(total)
        return cut_lineage(counts.filter(F.col("f") >= least))

    maps, counted = [word_map], []
    for size in range(2, min(3, longest) + 1):
        counted.append(often(maps, size, size))
        maps.append(_bitmap(counted[-1], F.col("hash"), pair_bits))
    if longest > 3:
        counted.append(often(maps, 4, longest))
    found = all_.unionByName(words.select("lang", F.array("word").alias("phrase"), "f"))
    for more in _named(rows, maps, counted, longest, pair_bits):
        found = found.unionByName(more)
    return found


def _named(rows: DataFrame, maps: Sequence[np.ndarray], counted: Sequence[DataFrame], longest: int, bits: int) -> list[DataFrame]:
    """``(lang, phrase, f)`` of the hashes counted, each named by the first share of the texts that holds it."""
    named: list[DataFrame] = []
    if not counted:
        return named
    missing = counted[0]
    for more in counted[1:]:
        missing = missing.unionByName(more)
    part = F.pmod(F.xxhash64("text"), F.lit(SHARES[-1]))
    for begin, end in zip(SHARES, SHARES[1:]):
        if missing.isEmpty():
            break
        wanted = _bitmap(missing, F.col("hash"), bits)
        share = rows.filter((part >= begin) & (part < end)).mapInArrow(_name_phrases(maps, wanted, longest), NAMES)
        some = cut_lineage(share.join(missing, "hash").groupBy("hash").agg(F.min(F.struct("lang", "phrase", "f")).alias("p")))
        named.append(some.select("p.lang", "p.phrase", "p.f"))
        missing = cut_lineage(missing.join(some, "hash", "left_anti"))
    return named


def _in_order(stream: DataFrame, order: str) -> tuple[DataFrame, dict[int, list], dict[int, tuple]]:
    """The stream sorted by (lang, order) in partitions by range; what stands before and after each partition."""
    stream = cut_lineage(stream.repartitionByRange("lang", order).sortWithinPartitions("lang", order)).withColumn("part", F.spark_partition_id())
    heads = stream.groupBy("part").agg(F.min(F.struct("lang", F.col(order).alias("words"), "f")).alias("h")).select("part", "h.lang", "h.words", "h.f")
    above = heads.filter(F.size("words") > 0).select("part", "lang", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda k: F.slice("words", 1, k))).alias(order))
    before: dict[int, list] = {}
    for r in above.join(stream.select("lang", order, "f"), ["lang", order]).collect():  # at most `longest` rows a partition
        before.setdefault(r["part"], []).append((len(r[order]), r["f"]))
    first = {r["part"]: (r["lang"], r["words"], r["f"]) for r in heads.collect()}  # one row a partition
    after = {}
    places = sorted(first)
    for a, b in zip(places, places[1:]):
        after[a] = first[b]
    return stream, before, after


def _along(before: dict, after: dict, order: str, take: Callable) -> Callable:
    """Reads a partition's rows in order; ``take(row, counts of its beginnings, whether the next row extends it as often)``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[int] = []
        held, lang = None, None

        def closed(row, next_):
            same = next_ is not None and next_[0] == row["lang"] and next_[2] == row["f"] and len(next_[1]) == len(row[order]) + 1 and next_[1][:-1] == row[order]
            return take(row, stack[: len(row[order])], same)

        part = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if part is None:
                    part, lang = row["part"], row["lang"]
                    stack = [f for _, f in sorted(before.get(part, []))]
                if held is not None:
                    out.append(closed(held, (row["lang"], row[order], row["f"])))
                stack[len(row[order]):] = [row["f"]]
                held = row
            yield from _given(out)
        if held is not None:
            yield from _given([closed(held, after.get(part))])
    return work


def _given(rows: list) -> Iterator[pa.RecordBatch]:
    rows = [r for r in rows if r is not None]
    if rows:
        kinds = {"lang": pa.string(), "phrase": pa.list_(pa.string()), "back": pa.list_(pa.string()), "f": pa.int64(), "left": pa.list_(pa.int64()), "covered": pa.bool_(),
                 "a": pa.int64(), "l": pa.int64(), "r": pa.int64(), "n": pa.int64(), "score": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in rows[0]], names=list(rows[0]))


def _left(row, counts, covered):
    return {"lang": row["lang"], "phrase": row["phrase"], "back": row["phrase"][::-1], "f": row["f"], "left": counts, "covered": covered}


def _scored(row, counts, covered):
    """``counts[j]``: of the last ``j`` words; ``left[k]``: of the first ``k``."""
    a, left, size = row["f"], row["left"], len(row["phrase"])
    if size < 2 or covered or row["covered"]:
        return None
    score, cut = min((1000 * a * left[0] // (left[k] * counts[size - k]), k) for k in range(1, size))
    return {"lang": row["lang"], "phrase": row["phrase"], "a": a, "l": left[cut], "r": counts[size - cut], "n": left[0], "score": score}


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 word_bits: int = BITS, pair_bits: int = PAIR_BITS) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of all phrases that no longer one covers; ``phrase`` is an array of words."""
    stream = frequent_phrases(docs, text, lang, least, longest, word_bits, pair_bits)
    stream, before, after = _in_order(stream, "phrase")
    left = stream.mapInArrow(_along(before, after, "phrase", _left), f"{STREAM.replace('f bigint', 'back array<string>, f bigint')}, left array<bigint>, covered boolean")
    stream, before, after = _in_order(left, "back")
    return stream.mapInArrow(_along(before, after, "back", _scored), "lang string, phrase array<string>, a bigint, l bigint, r bigint, n bigint, score bigint")




@query("op11_collocations")
def op11_collocations(spark, sf_dir):
    found = collocations(read(spark, sf_dir, "documents").select("lang", "text"))
    found = found.withColumn("phrase", F.array_join("phrase", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= TOP)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
