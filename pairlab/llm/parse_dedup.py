"""Removal of repeated byte strings by prefix-free parsing (operator 3).

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else in the corpus.

* **Parse.** A rolling hash of ``gram`` bytes runs over each text.  The trigger of
  a string of ``length`` bytes is its least gram hash (the leftmost such), so each
  string has one and it depends on nothing but the string.  Neighbouring strings
  with one trigger form a phrase: the text from the first of them to the end of
  the last.  Phrases overlap by ``length - 1`` bytes, so no string is cut.
* **Dictionary.** Equal strings have equal trigger grams at the same place, so only
  phrases that share their gram with another occurrence matter (about a quarter of
  them here); the others leave after a count of grams.  Where all occurrences of a
  gram are one phrase, all its strings repeat.  Phrases that occur twice or more
  repeat as a whole, too.
* **Order.** What is left are phrases that occur once and share the gram with other
  phrases (the edges of repeated passages).  The suffixes of these dictionary
  phrases are compared to the depth of ``length`` bytes: by the digest of their
  first ``length`` bytes under (gram, distance to the trigger), which groups exactly
  the suffixes that would be neighbours with a common prefix of that depth in the
  suffix order of the dictionary; the phrase counts stand for the parse.  One row
  carries sixteen neighbouring suffixes.

Compared are 64-bit hashes of the phrase or suffix together with the 64-bit hash of
the gram.  No group is collected but the rows of one document; counts of grams and
phrases are pre-aggregated, joins on hot grams are split by the skew handling, and
texts are shuffled once.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing;
rows are documents of their own, so a repeated row repeats all strings of its text;
rows with null ids take part; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.registry import query, read
from pairlab.session import cut_lineage

LENGTH, GRAM = 200, 100
CHUNK = 1 << 20  # strings parsed at a time, so that memory is bounded
BLOCK = 16  # suffixes in a row
_PLACE = np.uint64((1 << 21) - 1)

# 64-bit values of the bytes, the base of the rolling hash and its inverse
_VALUES = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class RollingHash:
    """Hashes of any substrings of one text of at most ``CHUNK`` and some bytes."""

    _powers = np.zeros(0, np.uint64)
    _inverses = np.zeros(0, np.uint64)

    def __init__(self, data: bytes):
        cls = RollingHash
        if len(data) >= len(cls._powers):
            n = max(1 << 14, 1 << len(data).bit_length())
            cls._powers = np.cumprod(np.full(n, _BASE, np.uint64))
            cls._inverses = np.cumprod(np.full(n, _INVERSE, np.uint64))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[np.frombuffer(data, np.uint8)] * cls._powers[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * RollingHash._inverses[start])


def phrases(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (gram hash, phrase hash, first string, strings, trigger) of one text, chunk by chunk."""
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at:at + CHUNK + length - 1]
        rolling = RollingHash(part)
        n, width = len(part) - length + 1, length - gram + 1
        hashes = rolling.of(np.arange(len(part) - gram + 1), gram)
        keyed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)  # the least, leftmost of equals
        full = np.full(-(-len(keyed) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        full[:len(keyed)] = keyed
        rows = full.reshape(-1, width)  # minimum of any ``width`` neighbours from running minima of blocks
        ahead = np.minimum.accumulate(rows, 1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        trigger = (np.minimum(back[:n], ahead[width - 1:width - 1 + n]) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
        count = np.diff(np.append(first, n))
        place = trigger[first]
        yield hashes[place], rolling.of(first, count + length - 1), first + at, count, place + at


def _pack(first, count, trigger):
    """Place of a phrase in its text as one number."""
    return (first * 256 + count) * 256 + (trigger - first)


def _unpack(place):
    return place >> 16, (place >> 8) & 255, place & 255


def occurrences(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """``(key, text)`` -> ``(gram, phrase, key, place)`` of all phrase occurrences."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [(g, p, np.full(len(g), key), _pack(first, count, trigger))
                     for key, text in zip(b["key"], b["text"])
                     for g, p, first, count, trigger in phrases(text.encode(), length, gram)]
            if parts:
                g, p, k, at = map(np.concatenate, zip(*parts))
                yield pd.DataFrame({"gram": g.view(np.int64), "phrase": p.view(np.int64), "key": k, "place": at})
    return keyed.select("key", "text").mapInPandas(run, "gram long, phrase long, key long, place long")


def _suffix_rows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, mine in zip(b["key"], b["text"], b["mine"]):
                data = text.encode()
                for m in mine:
                    first, count, off = _unpack(m["place"])
                    rolling = RollingHash(data[first:first + count + length - 1])
                    hashes = rolling.of(np.arange(count), length).view(np.int64)
                    block = (off - np.arange(count)) // BLOCK  # distance to the trigger, in blocks
                    for x in np.unique(block).tolist():
                        at = np.flatnonzero(block == x)
                        out.append((m["gram"], x, key, first + int(at[0]), m["n"], hashes[at]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["gram", "block", "key", "first", "n", "hashes"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["gram", "block", "key", "first", "n", "hashes"])
    return run


def repeated_strings(keyed: DataFrame, texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(key, first, count, mask)``: repeated strings start at the ``count`` places from ``first`` on,
    or, where ``mask`` isn't null, at those of its bits."""
    found = occurrences(keyed, length, gram)
    grams = (found.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("phrase").alias("a"), F.max("phrase").alias("b"))
             .filter("c > 1").select("gram", (F.col("a") == F.col("b")).alias("one")))
    # written first, so that both sides of the join are plain shuffles and hot grams can be split
    shared = cut_lineage(found.join(cut_lineage(grams), "gram"))
    first, count = F.expr("place >> 16").alias("first"), F.expr("(place >> 8) & 255").alias("count")
    whole = shared.filter("one").select("key", first, count)
    contested = shared.filter(~F.col("one"))
    dictionary = contested.groupBy("gram", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("at"))
    dictionary = cut_lineage(dictionary)
    again = contested.join(dictionary.filter("n > 1").select("gram", "phrase"), ["gram", "phrase"]).select("key", first, count)
    mine = (dictionary.select("at.key", F.struct("gram", "at.place", "n").alias("m")).groupBy("key")
            .agg(F.collect_list("m").alias("mine")).withColumnRenamed("key", "m_key"))
    suffixes = (texts.join(mine, F.col("key") == F.col("m_key")).select("key", "doc_id", "text", "mine")
                .mapInPandas(_suffix_rows(length), "gram long, block int, key long, first long, n long, hashes array<long>"))
    suffixes = suffixes.repartition("gram", "block").select("gram", "block", "key", "first", "n", F.posexplode("hashes").alias("i", "hash"))
    total = F.sum("n").over(Window.partitionBy("gram", "block", "hash"))
    bit = F.when((F.col("total") > 1) & (F.col("n") == 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("i"))).otherwise(F.lit(0).cast("bigint"))
    edges = (suffixes.withColumn("total", total).groupBy("gram", "block", "key", "first").agg(F.bit_or(bit).alias("mask"))
             .filter("mask != 0").select("key", "first", F.lit(0).cast("bigint").alias("count"), "mask"))
    none = F.lit(None).cast("bigint").alias("mask")
    return whole.select("*", none).unionByName(again.select("*", none)).unionByName(edges)


def _remove(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, found in zip(b["doc_id"], b["text"], b["found"]):
                data = text.encode()
                edge = np.zeros(len(data) + 1, np.int32)
                for f in found if found is not None else ():
                    if f["mask"] is None or f["mask"] != f["mask"]:
                        edge[f["first"]] += 1
                        edge[f["first"] + f["count"] - 1 + length] -= 1
                    else:
                        for i in range(BLOCK):
                            if int(f["mask"]) >> i & 1:
                                edge[f["first"] + i] += 1
                                edge[f["first"] + i + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                starts = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((doc, len(data), len(data) - len(kept), starts, kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
                    gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` for each row; ``kept`` holds the remaining bytes."""
    if not 0 < gram <= length <= gram + 254:
        raise ValueError("0 < gram <= length <= gram + 254")
    body = F.coalesce(F.col(text), F.lit(""))
    # doc_id may be null: it travels as a string, so that no null turns it into a double
    keyed = docs.select(F.xxhash64(F.col(doc_id), body).alias("key"), F.col(doc_id).cast("string").alias("doc_id"), body.alias("text"))
    texts = keyed.repartition("key")
    found = repeated_strings(keyed, texts, length, gram)
    found = found.groupBy(F.col("key").alias("f_key")).agg(F.collect_list(F.struct("first", "count", "mask")).alias("found"))
    out = (texts.join(found, F.col("key") == F.col("f_key"), "left").select("key", "doc_id", "text", "found")
           .mapInPandas(_remove(length), "doc_id string, n_bytes long, n_removed long, n_spans long, kept binary"))
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


@query("op3_repeat_removal")
def op3_repeat_removal(spark, sf_dir):
    out = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
