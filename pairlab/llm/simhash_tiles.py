"""SimHash near-dedup by tiled exact comparison (operator 7).

A fingerprint bit is set where over half of the shingles' XXH64 values set it.
Fingerprints are cut into ``segments`` pieces; two that differ in at most
``radius`` bits agree in at least ``segments - radius`` of them, so each distinct
fingerprint is put once under every choice of that many pieces and only rows
under one key are compared: exactly, with exclusive-or and bit counts in numpy,
ordered by population count so that tiles whose counts differ by more than the
radius are skipped.  ``segments`` changes only the number of keys (more for
larger corpora), never the result.

A key with more than ``tile`` fingerprints is dealt into tiles by population count
(and by hash where one count has many), and each pair of tiles whose counts lie within the
radius is a unit of work of its own, so no task compares a whole hot key.
A unit emits a spanning forest of its links (at most one row for each
fingerprint), not the pairs.  Exact copies are one fingerprint from the start.
Links go through connected components with checkpoints.

Defined results: a text without words (null, empty, blank) has fingerprint zero,
linked like any other; rows with null ids take part, the component's id is its
least non-null id (null if there is none); repeated rows are rows of their own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.components import connected_components
from pairlab.llm.registry import query, read
from pairlab.session import cut_lineage

SHINGLE, RADIUS, SEED = 4, 4, 42
SEGMENTS = 6
TILE = 4096
SMALL = 32  # groups up to this size are compared by shifts over the whole batch

_word = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    from xxhash import xxh64_intdigest

    words = _word.findall((text or "").encode().lower())  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):  # bounded memory for very long texts
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k:k + 65536].tolist(), last[k:k + 65536].tolist())), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(shingle: int = SHINGLE):
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64))
    return of


def _keys(fp, segments: int, radius: int):
    """Array of (table number, agreeing pieces) keys of a fingerprint column."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    piece = [F.shiftrightunsigned(F.shiftleft(fp, 64 - cuts[i + 1]), 64 - (cuts[i + 1] - cuts[i])) for i in range(segments)]
    return F.array(*(F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *(piece[i] for i in c)).alias("k"))
                     for t, c in enumerate(combinations(range(segments), segments - radius))))


def _forest(fp: np.ndarray, ones: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within one unit (``ones`` ascending)."""
    open_ = np.ones(len(fp), bool)
    links = []
    for root in range(len(fp)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            a, b = np.searchsorted(ones, [ones[i] - radius, ones[i] + radius + 1])  # tiles beyond are skipped
            at = a + np.flatnonzero(open_[a:b])
            near = at[np.bitwise_count(fp[at] ^ fp[i]) <= radius]
            open_[near] = False
            links += [(i, j) for j in near.tolist()]
            queue += near.tolist()
    return links


def _links(radius: int):
    def links(unit: np.ndarray, fp: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of whole units; rows ordered by unit, then population count."""
        first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        size = np.diff(np.append(first, len(unit)))
        big = size > SMALL
        a, b = [], []
        for i, n in zip(first[big].tolist(), size[big].tolist()):
            got = _forest(fp[i:i + n], ones[i:i + n], radius)
            a += [i + x for x, _ in got]
            b += [i + y for _, y in got]
        rest = np.repeat(np.where(big, 0, size), size)  # rows of the unit, 0 in big ones
        place = np.arange(len(unit)) - np.repeat(first, size)
        pairs = [(np.array(a, np.int64), np.array(b, np.int64))]
        for s in range(1, SMALL):
            at = np.flatnonzero(place + s < rest)
            if not len(at):
                break
            at = at[ones[at + s] - ones[at] <= radius]
            at = at[np.bitwise_count(fp[at] ^ fp[at + s]) <= radius]
            pairs.append((at, at + s))
        return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # the last unit of a batch may go on in the next
        def out(x):
            fp = x["fp"].to_numpy().astype(np.uint64)
            i, j = links(x["unit"].to_numpy(), fp, x["ones"].to_numpy())
            return pd.DataFrame({"a": fp[i].astype(np.int64), "b": fp[j].astype(np.int64)})
        for batch in batches:
            x = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            last = x["unit"].to_numpy()[-1:]
            whole = int(np.searchsorted(x["unit"].to_numpy(), last[0])) if len(x) else 0
            if whole:
                yield out(x.iloc[:whole].reset_index(drop=True))
            kept = x.iloc[whole:].reset_index(drop=True)
        if kept is not None and len(kept):
            yield out(kept)
    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """Distinct ``(fp)`` -> ``(a, b)``: links that join all fingerprints within the radius."""
    rows = distinct.select("fp", F.bit_count("fp").alias("ones"), F.explode(_keys(F.col("fp"), segments, radius)).alias("key")).select("fp", "ones", "key.t", "key.k")
    # tiles of a hot key: its fingerprints by population count, and by hash where one count has many
    shares = F.struct("ones", F.ceil(F.col("n") * 2 / tile).cast("int").alias("tiles"))
    hot = (rows.groupBy("t", "k", "ones").agg(F.count(F.lit(1)).alias("n")).groupBy("t", "k")
           .agg(F.sum("n").alias("all"), F.collect_list(shares).alias("shares")).filter(F.col("all") > tile).select("t", "k", "shares"))
    rows = rows.join(hot, ["t", "k"], "left")
    own = F.element_at(F.filter("shares", lambda x: x["ones"] == F.col("ones")), 1)["tiles"]
    rows = rows.withColumn("mine", F.struct(F.col("ones").alias("ones"), F.pmod(F.xxhash64("fp", F.lit("tile")), own).cast("int").alias("part")))
    # only tiles whose counts lie within the radius meet
    near = F.filter("shares", lambda x: F.abs(x["ones"] - F.col("ones")) <= radius)
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["tiles"] - 1), lambda i: F.struct(x["ones"].alias("ones"), i.alias("part")))))
    pairs = F.transform(others, lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j")))
    one = F.struct(F.lit(-1).alias("ones"), F.lit(0).alias("part"))
    pairs = F.coalesce(pairs, F.array(F.struct(one.alias("i"), one.alias("j"))))
    units = (rows.select("fp", "ones", "t", "k", F.explode(pairs).alias("pair"))
             .select("fp", F.xxhash64("t", "k", "pair.i", "pair.j").alias("unit"), "ones"))
    return (units.repartition("unit").sortWithinPartitions("unit", "ones", "fp")
            .mapInPandas(_links(radius), "a long, b long").distinct())


def with_components(rows: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """``(doc_id, fp, ...)`` -> the same with ``component`` (a fingerprint) and ``component_id``."""
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = connected_components(fingerprint_links(distinct, radius, segments, tile)).withColumnRenamed("node", "fp")
    named = distinct.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(named.select("fp", "component").join(least, "component"), "fp")


def fingerprint_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, digest, fp)`` of every row; the digest tells texts under one id apart."""
    return cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
                                   fingerprints(shingle)(F.col(text)).alias("fp")))


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                   radius: int = RADIUS, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """``(doc_id, digest, fp, component, component_id)``, a row for each document row."""
    return with_components(fingerprint_rows(docs, text, doc_id, shingle), radius, segments, tile)


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark, sf_dir):
    groups = simhash_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
