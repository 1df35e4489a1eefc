"""N-gram Jaccard join on parity sketches (operator 12).

Two texts link if the sets of their distinct word shingles have a Jaccard similarity
of at least ``similarity`` percent; each row gets the component of its text.

* Each shingle flips one bit of a sketch, so two sketches differ in no more bits than
  the sets in elements.  Sizes bound the difference of similar sets (``difference_bound``).
* Set sizes are dealt into bands; a layout belongs to a band and cuts the sketch into
  one piece more than sets of the band can differ, so similar sets agree in a piece.
  Pieces are ordered by their number of set bits, then by hash: the first
  ``bound + 1`` pieces of each set must hold an agreeing one (a set can miss no more),
  and they are the most selective.  A set also takes part in the next band's layout
  if a partner may be there.  Pieces meet by key, in one sorted pass.
* Equal sets are one node from the start.  Each node is first verified against the
  node it meets in most keys; links make components.  Of keys with the same nodes one goes on
  (with their number), as long as it holds several components: there all nodes beside the
  largest component are compared with all others on a smaller sketch of one word for 64 elements, by
  exclusive-or and bit counts, keys of more nodes than a tile in tiles within size classes.  The
  nearest of the pairs within the bound are verified.  Where a node has further ones, its keys go
  on with more and more of them, until none is left whose ends lie in different components.
  Each round reads only the keys that held several components in the round before.
* Verification is exact, on the sets of shingle hashes (64 bits).

Every pair that could link two components is verified, so components are exact, while
large groups of copies are never expanded into pairs.

Defined results: null, empty and blank texts have no shingles and link with nothing; with
fewer words than a shingle the whole sequence is one; repeated rows and rows with equal ids are rows
of their own; rows with null ids take part, a component's id is its least non-null id (null if
there is none); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions.pieces import pieces
from pairlab.llm.components import connected_components
from pairlab.llm.hash_filter import bitmap_of, may_hold
from pairlab.llm.registry import query, read
from pairlab.session import scratch_path

SHINGLE, SIMILARITY = 4, 85
SPREAD = 3  # greatest size of a band by its least
POSITION_BITS = 24  # bits of a piece: 2 ** 24
TILE = 1024  # nodes of a size class compared in one unit of work
NEAREST = 16  # pairs of a node verified in the first round, times as many in each further one
_LOWER_BAND = 1 << 62  # marks a node that a key holds from the band below
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all (splitmix finaliser)."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles (with fewer words: of the whole sequence)."""
    words = [(t or b"").translate(LOWER).split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(lengths.sum()), object)
    flat[:] = [x for w in words for x in w]
    codes, names = pd.factorize(flat)
    of_word = np.array([xxhash.xxh64_intdigest(x, 42) for x in names], np.uint64)
    each = of_word[codes] if len(codes) else np.empty(0, np.uint64)
    whole = each.copy()
    n = len(each)
    for k in range(1, shingle):
        after = np.zeros(n, np.uint64)
        after[: max(0, n - k)] = each[k:]
        whole = mix(whole) + after
    sets, ends = [], np.cumsum(lengths)
    for length, end in zip(lengths.tolist(), ends.tolist()):
        if length >= shingle:
            sets.append(np.unique(whole[end - length: end - shingle + 1]))
        elif length:
            one = each[end - length: end - length + 1]
            for k in range(1, length):
                one = mix(one) + each[end - length + k: end - length + k + 1]
            sets.append(mix(one ^ np.uint64(length)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


@cache
def bands(spread: int = SPREAD) -> list[int]:
    """Least set size of each band."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * spread)
    return low


def difference_bound(a: int, b: int, similarity: int = SIMILARITY) -> int:
    """Greatest symmetric difference of sets of these sizes at the similarity (percent)."""
    return (100 - similarity) * (a + b) // (100 + similarity)


def layout_keys(x: np.ndarray, layout: int, similarity: int = SIMILARITY) -> np.ndarray:
    """The keys a set emits in one layout: of its pieces the heaviest, one more than can differ from a partner's."""
    low = bands()
    most = low[layout + 1] - 1
    n = len(x)
    pieces = difference_bound(most, most, similarity) + 1
    emitted = difference_bound(n, min(most, n * 100 // similarity), similarity) + 1
    h = mix(x ^ np.uint64((layout + 1) * 0x1000193))
    piece = ((h >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
    bit = (piece << np.uint64(POSITION_BITS)) | (h & np.uint64((1 << POSITION_BITS) - 1))
    bit, times = np.unique(bit, return_counts=True)
    bit = bit[times % 2 == 1]  # the set bits of the sketch
    piece = (bit >> np.uint64(POSITION_BITS)).astype(np.int64)
    weight = np.bincount(piece, minlength=pieces)
    value = np.zeros(pieces, np.uint64)
    starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]][: len(piece)])
    if len(starts):
        value[piece[starts]] = np.bitwise_xor.reduceat(mix(bit), starts)
    key = mix(value ^ mix(np.arange(pieces, dtype=np.uint64) + np.uint64((layout + 1) << 40)))
    if emitted < pieces:
        key = key[np.lexsort((key, -weight))[:emitted]]
    return key


def sketch_keys(x: np.ndarray, similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Keys in the layout of the set's own band, and in the next one's if a partner can reach that band."""
    low, none = bands(), np.empty(0, np.uint64)
    n = len(x)
    if not n:
        return none, none
    own = int(np.searchsorted(low, n, "right")) - 1
    out = []
    for layout in (own, own + 1):
        reach = n * 100 // similarity
        if layout > own and reach < low[layout]:
            out.append(none)
        elif difference_bound(n, min(low[layout + 1] - 1, reach), similarity) == 0:
            out.append(none)  # only equal sets
        else:
            out.append(layout_keys(x, layout, similarity))
    return out[0], out[1]


def small_sketch(x: np.ndarray, layout: int) -> bytes:
    """Parities of the set's elements over as many bits as the layout's largest set has elements."""
    words = (bands()[layout + 1] + 63) // 64
    h = mix(x ^ np.uint64((layout + 1) * 0x85EBCA77))
    bit = (((h >> np.uint64(32)) * np.uint64(words * 64)) >> np.uint64(32)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=words * 64) % 2 == 1).tobytes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ta, tb, text) -> the same without the text, then set size, digest and keys."""
    longs = pa.list_(pa.int64())
    for batch in (piece for whole in batches for piece in pieces(whole)):
        sets = shingle_sets(batch.column(3).cast(pa.binary()).to_pylist())
        keys = [sketch_keys(x) for x in sets]
        h1 = np.array([mix(x).sum(dtype=np.uint64) for x in sets], np.uint64)
        h2 = np.array([np.bitwise_xor.reduce(mix(x ^ _M1)) if len(x) else 0 for x in sets], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([len(x) for x in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
             pa.array([a.view(np.int64) for a, _ in keys], longs), pa.array([b.view(np.int64) for _, b in keys], longs)],
            names=["doc_id", "ta", "tb", "n", "h1", "h2", "own", "upper"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, mark) sorted by both -> (key, node, lower, rep) of the keys that several nodes hold, one of them in its own band.

    Nodes in their own band come first, so the first row of a key tells whether it counts, and is its ``rep``.
    """
    key0, first0, seen0 = None, 0, 0
    for batch in batches:
        key, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        start = np.r_[key0 is None or key[0] != key0, key[1:] != key[:-1]]
        at = np.maximum.accumulate(np.where(start, np.arange(len(key)), -1))
        first = np.where(at >= 0, mark[np.maximum(at, 0)], first0)
        place = np.arange(len(key)) - np.where(at >= 0, at, -seen0)
        counts = first < _LOWER_BAND
        second = counts & (place == 1)  # the first row is written when there is a second
        rest = counts & (place >= 1)
        k = np.r_[key[second], key[rest]]
        m = np.r_[first[second], mark[rest]]
        rep = np.r_[first[second], first[rest]]
        if len(k):
            yield pa.RecordBatch.from_arrays(
                [pa.array(k), pa.array(m & (_LOWER_BAND - 1)), pa.array(m >= _LOWER_BAND), pa.array(rep)], names=["key", "node", "lower", "rep"])
        key0, first0, seen0 = key[-1], first[-1], int(place[-1]) + 1


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, n, shingles, own and upper small sketch)."""
    for batch in (piece for whole in batches for piece in pieces(whole)):
        sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())
        own = [int(np.searchsorted(bands(), max(1, len(x)), "right")) - 1 for x in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
             pa.array([small_sketch(x, k) for x, k in zip(sets, own)], pa.binary()), pa.array([small_sketch(x, k + 1) for x, k in zip(sets, own)], pa.binary())],
            names=["node", "n", "shingles", "own", "upper"])


def _near_pairs(node: np.ndarray, component: np.ndarray, size: np.ndarray, tile: np.ndarray, sketches: list[bytes], similarity: int, nearest: int):
    """Pairs of a unit within the bound: of each node those of the ``nearest`` that lie in another component.

    A node that has further ones is also given with itself.
    """
    found: list[tuple[int, int]] = []
    order = np.lexsort((node, component))
    node, component, size, tile = node[order], component[order], size[order], tile[order]
    words = np.frombuffer(b"".join(sketches[i] for i in order), np.uint64).reshape(len(node), -1)
    starts = np.flatnonzero(np.r_[True, component[1:] != component[:-1]])
    lengths = np.diff(np.r_[starts, len(node)])
    main = component[starts[np.argmax(lengths)]]
    two = tile.min() != tile.max()
    for i in np.flatnonzero(component != main):
        away = np.bitwise_count(words ^ words[i]).sum(1).astype(np.int64)
        fits = (away <= (100 - similarity) * (size + size[i]) // (100 + similarity)) & (100 * np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]))
        if two:
            fits &= tile != tile[i]
        fits[i] = False
        near = np.flatnonzero(fits)
        if not len(near):
            continue
        near = near[np.lexsort((node[near], away[near]))]
        other = component[near] != component[i]
        found += [(min(node[i], node[j]), max(node[i], node[j])) for j in near[:nearest][other[:nearest]]]
        if other[nearest:].any():
            found.append((node[i], node[i]))
    return found


def _compared(similarity: int, nearest: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units follow each other in sorted order; each is compared when its last row is there."""
        held: list[pa.RecordBatch] = []

        def done() -> list[tuple[int, int]]:
            rows = pa.Table.from_batches(held)
            col = {c: rows[c].to_numpy() for c in ("node", "component", "n", "tile", "unit_a", "unit_b", "unit_c", "unit_d")}
            ends = np.flatnonzero(np.r_[np.any([col[c][1:] != col[c][:-1] for c in ("unit_a", "unit_b", "unit_c", "unit_d")], axis=0), True]) + 1
            sketches, out, begin = rows["sketch"].to_pylist(), [], 0
            for end in ends.tolist():
                part = slice(begin, end)
                begin = end
                comps = col["component"][part]
                if (comps != comps[0]).any() and len({len(s) for s in sketches[part]}) == 1:
                    out += _near_pairs(col["node"][part], comps, col["n"][part], col["tile"][part], sketches[part], similarity, nearest)
            return out

        def give(found):
            return pa.RecordBatch.from_arrays([pa.array([int(a) for a, _ in found], pa.int64()), pa.array([int(b) for _, b in found], pa.int64())], names=["a", "b"])

        unit = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [tuple(batch.column(c)[r].as_py() for c in range(4)) for r in (0, batch.num_rows - 1)]
            if ids[0] == ids[1] == unit:
                held.append(batch)
                continue
            keys = [batch.column(c).to_numpy() for c in range(4)]
            last = int(np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0)).max(initial=-1)) + 1  # where the last unit begins
            if unit is not None and last == 0 and ids[1] != unit:
                yield give(done())
                held = []
            if last:
                held.append(batch.slice(0, last))
                yield give(done())
                held = []
            held.append(batch.slice(last))
            unit = ids[1]
        if held:
            yield give(done())
    return work


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("shingles").alias(f"{s}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return both.filter(100 * shared >= similarity * (F.col("a_n") + F.col("b_n") - shared)).select("a", "b")


def _distinct_keys(members: DataFrame) -> DataFrame:
    """``(key, times)``: of keys with the same nodes one, and how many they are.

    Same nodes: equal in number and in two sums of 64-bit hashes.
    """
    total = lambda *of: F.sum(F.xxhash64(*of).cast("decimal(20,0)"))
    keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("held"), total("node", "lower").alias("sum_a"), total("lower", "node").alias("sum_b"))
    return keys.groupBy("held", "sum_a", "sum_b").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times")).select("key", "times")


def similar_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: int = SIMILARITY,
                       tile: int = TILE, nearest: int = NEAREST) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``."""
    spark = docs.sparkSession
    folder = scratch_path(spark, f"parity-{uuid.uuid4().hex}")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("ta"), F.xxhash64(F.lit(1), body).alias("tb"), body.alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    signed = written(rows.mapInArrow(_signatures, f"doc_id {id_type}, ta bigint, tb bigint, n bigint, h1 bigint, h2 bigint, own array<bigint>, upper array<bigint>")
                     .withColumn("id", F.monotonically_increasing_id()), "signed")
    classes = written(signed.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("node"), F.min("doc_id").alias("least")), "classes")

    marked = lambda keys, mark: F.transform(keys, lambda k: F.struct(k.alias("key"), mark.alias("mark")))
    keys = (signed.select("id", "own", "upper").join(classes.select(F.col("node").alias("id")), "id")
            .select(F.explode(F.concat(marked(F.col("own"), F.col("id")), marked(F.col("upper"), F.col("id") + F.lit(_LOWER_BAND)))).alias("e")).select("e.*"))
    members = written(keys.repartition("key").sortWithinPartitions("key", "mark")
                      .mapInArrow(_groups, "key bigint, node bigint, lower boolean, rep bigint"), "members")
    members = written(members.join(_distinct_keys(members), "key"), "distinct")

    # texts of the nodes that meet others: thinned out by a bitmap, joined exactly
    needed = written(members.select("node").distinct().join(signed.select(F.col("id").alias("node"), "doc_id", "ta", "tb"), "node"), "needed")
    bitmap = bitmap_of(needed, F.col("ta"))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bitmap, batch.column(1).to_numpy().view(np.uint64))))

    wanted = needed.select("node", *(F.col(c).alias(f"{c}_") for c in ("doc_id", "ta", "tb")))
    same = (F.col("ta") == F.col("ta_")) & (F.col("tb") == F.col("tb_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_"))
    texts = rows.mapInArrow(thinned, rows.schema).join(wanted, same).select("node", "text").dropDuplicates(["node"])
    sets = written(texts.mapInArrow(_sets, "node bigint, n bigint, shingles array<bigint>, own binary, upper binary"), "sets")

    votes = members.filter("node <> rep").groupBy("node", "rep").agg(F.sum("times").alias("votes"))
    best = votes.groupBy(F.col("node").alias("b")).agg(F.max_by("rep", F.struct("votes", -F.col("rep"))).alias("a")).select("a", "b")
    links = written(_verified(best, sets, similarity), "links0")
    turn, growth = 0, nearest
    # a partner's size lies in the same size class or in a neighbouring one
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / similarity)) + 1e-9).cast("bigint")
    sized = sets.select("node", "n", size_class.alias("class"), "own", "upper")
    while True:
        components = connected_components(links)
        label = components.select("node", "component", F.lit(not turn).alias("further"))
        if turn:
            label = components.join(further.withColumn("further", F.lit(True)), "node", "full").select("node", F.coalesce("component", "node").alias("component"), "further")
        tagged = members.select("key", "node", "lower").join(label, "node", "left")
        tagged = tagged.select("key", "node", "lower", F.coalesce("component", "node").alias("component"), F.coalesce("further", F.lit(not turn)).alias("further"))
        tagged = written(tagged, f"tagged{turn}")
        keys = tagged.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("further").alias("open"), F.count(F.lit(1)).alias("held"))
        members = written(tagged.join(keys.filter("x <> y").select("key", "open", "held"), "key"), f"mixed{turn}")  # the others stay in one component
        spread = (members.filter("open").join(sized, "node")
                  .withColumn("sketch", F.when(F.col("lower"), F.col("upper")).otherwise(F.col("own")))
                  .withColumn("classes", F.when(F.col("held") > tile, F.array("class", F.col("class") + 1)).otherwise(F.array(F.lit(-1).cast("bigint"))))
                  .select("key", "node", "component", "further", "n", "sketch", F.explode("classes").alias("class")))
        spread = written(spread, f"spread{turn}")
        units = (spread.groupBy("key", "class").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("further").alias("further"), F.count(F.lit(1)).alias("held"))
                 .filter("x <> y and further").select("key", "class", F.ceil(F.col("held") / tile).cast("int").alias("tiles")))
        dealt = spread.join(units, ["key", "class"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.select(F.col("key").alias("unit_a"), F.col("class").alias("unit_b"), F.least("tile", "other").alias("unit_c"), F.greatest("tile", "other").alias("unit_d"),
                             "node", "component", "n", "tile", "sketch")
        unit = ["unit_a", "unit_b", "unit_c", "unit_d"]
        near = dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_compared(similarity, nearest), "a bigint, b bigint").distinct()
        near = written(near, f"near{turn}")
        turn, nearest = turn + 1, nearest * growth
        pairs, further = near.filter("a <> b"), near.filter("a = b").select(F.col("a").alias("node"))
        last = further.isEmpty()
        if not pairs.isEmpty():
            links = links.unionByName(written(_verified(pairs, sets, similarity), f"links{turn}"))
            if last:
                components = connected_components(links)
        if last:
            break

    least = classes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(least.join(ids, "component").select("h1", "h2", "component_id"), "named")
    alone = signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return signed.filter("n > 0").join(named, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


@query("op12_parity_join")
def op12_parity_join(spark, sf_dir):
    return similar_components(read(spark, sf_dir, "documents").select("doc_id", "text"))
