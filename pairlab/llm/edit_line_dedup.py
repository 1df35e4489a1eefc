"""Line dedup by a segment-partition edit join (operator 10), DataFrame functions only.

Lines (split at line feeds) of at least ``min_chars`` characters take part; two are
duplicates if their texts differ in at most ``distance`` (1 or 2) edits.  Of all lines in
(document id, line number) order, a line goes if the same text stands earlier, or
if a text within the distance has its first occurrence before this text's first.
With ``short_lines`` the shorter lines that hold a word take part too, as equals only.

* Distinct lines are found by a pre-aggregated group on two 64-bit digests; their
  texts aren't shuffled for it.  The same group keeps their keys.
* Lengths fall into classes of an eighth or so.  A line is cut into ``distance + 1`` segments
  whose size is that of its class: the first, the last, and one between them.  Of two lines within
  the distance one segment is unchanged; the first stands at the start, the last at the end, and where only
  the one between is unchanged, one edit stands before it, so that it is found at
  one of three places.  A line near the end of its class has keys in the next one too.
* Only keys that several lines hold go on.  In each round every line that is not
  decided meets the earliest lines of its keys that it hasn't met yet; banded
  bit-parallel edit distance (one 64-bit word for the band) decides, and a line with
  a partner leaves.  One partner is enough, so groups of near-equal lines never become pairs.
  The join itself drops pairs whose signatures (64 parities of hashed pairs of neighbouring
  characters, of which an edit changes four at most) differ too much.
* Rounds take ever more lines, until every undecided line has met all earlier ones of its keys.
  Keys with very many lines left after their first round are refined instead: their lines are
  cut into more segments of which all but ``distance`` are a key, so that what
  they share beside the hot segment counts as well; then again, into still more.
* Texts of the lines that meet others are fetched by an exact join, thinned out before by a bitmap of fixed size.

Defined results: a null text has no lines; repeated rows, and rows with the same id in the
same place of a line, keep or lose it alike; null ids order last, by a digest of the text, so
that of different rows without an id only the first keeps a line they share;
an empty table gives no rows; other columns pass through, whatever their names (those named like a result give way).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.packing import packed, unpacked
from pairlab.llm.registry import query, read
from pairlab.session import scratch_path

# two edits: another year, a two-digit page number, a swapped pair of letters
DISTANCE, MIN_CHARS = 2, 20
_WORD = r"[^\x20\x09-\x0D]"
OUT = ["n_lines", "n_removed", "removed"]
REFINED = (8, 16)  # segments of the finer keys
FIRST_ROUND = 16  # earliest lines of a key met in the first round
GROWTH = 8  # times as many in each further one
REFINE_ABOVE = 4096  # lines left with a key; up to there meeting them is cheaper than their finer keys
BITMAP_BITS = 25  # 4 MB, see _thinned


def _integer(x: Column) -> Column:
    return x.cast("int")


def length_class(length: Column) -> Column:
    """The least length of the class: the four leading bits stay (classes are two wide at least)."""
    low = F.greatest(F.lit(1), F.length(F.bin(length.cast("bigint"))) - 4)
    return _integer(F.call_function("shiftleft", F.call_function("shiftright", length, low), low))


def segment_keys(line: Column, of: Column, distance: int) -> list[Column]:
    """Keys of a line in a class: its first and last segment, and what stands about the place of the one between."""
    size = _integer(F.floor((of - distance) / (distance + 1)))
    keys = [F.xxhash64(of, F.lit(0), line.substr(F.lit(1), size)), F.xxhash64(of, F.lit(1), line.substr(F.length(line) - size + 1, size))]
    if distance == 2:
        keys += [F.xxhash64(of, F.lit(2), line.substr(size + 1 + shift, size)) for shift in (-1, 0, 1)]
    return keys


def refined_keys(line: Column, of: Column, distance: int, pieces: int) -> Column:
    """Keys of all but ``distance`` of the pieces: the edits lie in pieces ``i`` and ``j``, what stands between them may be shifted by one."""
    size = _integer(F.floor((of - distance) / pieces))
    if distance == 1:
        bad = [(i, i, 0) for i in range(pieces)]
    else:
        bad = [(i, j, shift) for i in range(pieces) for j in range(i + 1, pieces) for shift in ((0,) if j == i + 1 else (-1, 0, 1))]
    choices = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(s).alias("s")) for i, j, s in bad))

    def key(c: Column) -> Column:
        tail = (pieces - 1 - c["j"]) * size
        return F.xxhash64(of, F.lit(pieces), c["i"], c["j"], line.substr(F.lit(1), c["i"] * size),
                          line.substr((c["i"] + 1) * size + c["s"] + 1, F.greatest(F.lit(0), (c["j"] - c["i"] - 1) * size)),
                          line.substr(F.length(line) - tail + 1, tail))
    return F.transform(choices, key)


def signature(line: Column) -> Column:
    """Parities of the hashes of all pairs of neighbouring characters."""
    def of(chars: Column) -> Column:
        pairs = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.xxhash64(a, b))
        flip = lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int")))
        return F.aggregate(pairs, F.lit(0).cast("bigint"), flip)
    return F.element_at(F.transform(F.array(F.split(line, "")), of), 1)


def in_classes(line: Column, distance: int, keys) -> Column:
    """``keys(class)`` in the line's own class, and in the next if a partner may be there."""
    own, next_ = length_class(F.length(line)), length_class(F.length(line) + distance)
    return F.array_distinct(F.concat(keys(own), F.when(next_ > own, keys(next_)).otherwise(F.array().cast("array<bigint>"))))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def banded_distance(a: Column, b: Column, distance: int) -> Column:
    """Edit distance of two strings if at most ``distance``, else a larger number.

    Column ``j`` of the matrix (characters of the shorter string) keeps the rows
    ``j - distance .. j + distance`` (characters of the longer one) as bits; vertical
    differences move one row up from column to column, and the distance is summed
    along the diagonal that ends in the last cell.
    """
    width = 2 * distance + 1
    full = (1 << width) - 1
    swap = F.length(a) < F.length(b)
    rows = F.split(F.when(swap, b).otherwise(a), "")
    cols = F.split(F.when(swap, a).otherwise(b), "")
    gap = F.abs(F.length(a) - F.length(b))
    n = lambda x: F.lit(x).cast("bigint")
    inv = lambda x: x.bitwiseXOR(n(full))

    def step(s: Column, j: Column, pattern: Column, text: Column) -> Column:
        same = [F.when(F.get(pattern, j - distance + d) == F.get(text, j), n(1 << d)).otherwise(n(0)) for d in range(width)]
        match = reduce(lambda x, y: x + y, same)
        vp, vn = s["vp"], s["vn"]

        def with_match(x: Column) -> Column:
            diagonal = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(n(full))

            def with_diagonal(d0: Column) -> Column:
                hp, hn = vn.bitwiseOR(inv(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
                up = F.shiftright(d0, 1)
                return F.struct(hn.bitwiseOR(inv(up.bitwiseOR(hp))).alias("vp"), up.bitwiseAND(hp).alias("vn"),
                                (s["sum"] + 1 - F.call_function("shiftright", d0, (s["end"]).cast("int")).bitwiseAND(n(1))).alias("sum"), s["end"].alias("end"))
            return _let(diagonal, with_diagonal)
        return _let(match, with_match)

    start = F.struct(n(full ^ ((1 << distance) - 1)).alias("vp"), n(0).alias("vn"), gap.cast("bigint").alias("sum"),
                     (gap + distance).cast("bigint").alias("end"))
    both = F.struct(rows.alias("rows"), cols.alias("cols"))
    found = _let(both, lambda t: F.aggregate(F.sequence(F.lit(0), F.size(t["cols"]) - 1), start,
                                             lambda s, j: step(s, j, t["rows"], t["cols"]), lambda s: s["sum"]))
    return F.when(gap > distance, gap.cast("bigint")).otherwise(found)


def lines_of(rows: DataFrame, min_chars: int = MIN_CHARS, short_lines: bool = False) -> DataFrame:
    """``(r1, r2, pos, place, line, h1, h2)`` of the lines that take part; ``place`` orders them.

    ``rows`` has ``doc_id`` and ``body``; ``r1, r2`` is a digest of a row.
    """
    # without an id: a digest of the text, past every id
    digest = F.xxhash64("body").cast("decimal(38,0)")
    late = F.coalesce(F.col("doc_id").cast("decimal(38,0)"), (digest + F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(38,0)"))
    each = rows.select(*_row_digest(), late.alias("doc"), F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    long = F.length("line") >= min_chars
    return each.filter(long | F.col("line").rlike(_WORD) if short_lines else long).select(
        "r1", "r2", "pos", (F.col("doc") * (1 << 31) + F.col("pos")).cast("decimal(38,0)").alias("place"), "line",
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def _row_digest() -> list[Column]:
    return [F.xxhash64("doc_id", "body").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "body").alias("r2")]


def _thinned(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines whose digest may be among the wanted ones: a bitmap of ``2 ** BITMAP_BITS`` bits, in pages of 4 KB."""
    slot = F.col("h1").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    pages = (wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("page"))
             .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits")))
    at = slot.bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substr("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    # the broadcast is bounded: 2 ** BITMAP_BITS / 32768 pages
    return lines.join(F.broadcast(pages), (F.shiftright(slot, 15) == F.col("page")) & held).select(*lines.columns)


def late_lines(lines: DataFrame, firsts: DataFrame, written, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(first, h1)`` of the distinct lines that have an earlier partner.

    ``firsts`` has ``(h1, h2, first, keys)``; ``written(df, name)`` writes a table and reads it back.
    A line is told by its first place and a digest: rows with the same id share their places.
    """
    node = F.struct("first", "h1").alias("node")
    each = firsts.select("h1", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("key")
    held = written(each.join(shared, "key").join(firsts.select("h1", "first"), "h1").select("key", node), "held")
    wanted = written(held.select("node").distinct().join(firsts.select(node, "h2"), "node").select("node", "node.*", "h2"), "wanted")
    at = wanted.select("node", "first", F.col("h1").alias("w1"), F.col("h2").alias("w2"))
    here = (F.col("place") == F.col("first")) & (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2"))
    near = lines.filter(F.length("line") >= min_chars)
    texts = _thinned(near.select("place", "h1", "h2", "line"), wanted).join(at, here).select("node", "line").dropDuplicates(["node"])
    texts = written(texts.withColumn("sig", signature(F.col("line"))), "texts")
    unmet = F.lit(None).cast(held.schema["node"].dataType).alias("met")
    members = written(held.join(texts.select("node", "sig"), "node").select("key", "node", "sig", unmet), "members")

    decided = members.select("node").limit(0)
    turn = 0
    for pieces in (None, *REFINED):
        if pieces:
            open_ = texts.join(members.select("node").distinct(), "node")
            each = open_.select("node", "sig", F.explode(in_classes(F.col("line"), distance, lambda c: refined_keys(F.col("line"), c, distance, pieces))).alias("key"))
            each = written(each, f"refined{pieces}")
            shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("key")
            members = written(each.join(shared, "key").select("key", "node", "sig", unmet), f"members{pieces}")
        hot, quota = members.limit(0), FIRST_ROUND
        while not members.isEmpty():
            turn += 1
            members, found = _round(members, texts, decided, quota, distance, written, turn)
            decided = written(decided.union(found).distinct(), f"decided{turn}")
            members = _still_open(members, decided, written, turn)
            if quota == FIRST_ROUND and pieces != REFINED[-1]:
                hot, members = members.filter(F.col("left") > REFINE_ABOVE), members.filter(F.col("left") <= REFINE_ABOVE)
            quota *= GROWTH
        members = hot
        if members.isEmpty():
            break
    return decided.select("node.*")


def _round(members: DataFrame, texts: DataFrame, decided: DataFrame, quota: int, distance: int, written, turn: int) -> tuple[DataFrame, DataFrame]:
    """Each undecided line meets the next ``quota`` lines of its keys that come before it."""
    ahead = members.filter(F.col("met").isNull() | (F.col("node") > F.col("met")))
    place = F.row_number().over(Window.partitionBy("key").orderBy("node"))
    next_ = written(ahead.withColumn("at", place).filter(F.col("at") <= quota).select("key", F.col("node").alias("earlier"), F.col("sig").alias("other_sig")), f"next{turn}")
    undecided = members.select("key", "node", "sig").join(decided, "node", "left_anti")
    close = F.bit_count(F.col("sig").bitwiseXOR(F.col("other_sig"))) <= 4 * distance
    pairs = undecided.alias("x").join(next_.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("earlier.first") < F.col("node.first")) & close)
    pairs = pairs.select("node", "earlier").distinct()
    both = pairs.join(texts.select("node", "line"), "node").join(texts.select(F.col("node").alias("earlier"), F.col("line").alias("other")), "earlier")
    found = written(both.filter(banded_distance(F.col("line"), F.col("other"), distance) <= distance).select("node").distinct(), f"found{turn}")
    reached = next_.groupBy("key").agg(F.max("earlier").alias("met"))
    return members.select("key", "node", "sig").join(reached, "key").select("key", "node", "sig", "met"), found


def _still_open(members: DataFrame, decided: DataFrame, written, turn: int) -> DataFrame:
    """Members of the keys that hold an undecided line after one it hasn't met; ``left``: how many the key has."""
    known = members.join(decided.select("node", F.lit(True).alias("done")), "node", "left")
    open_ = (known.groupBy("key").agg(F.max(F.when(F.col("done").isNull(), F.col("node.first"))).alias("last"),
                                      F.min(F.when(F.col("node") > F.col("met"), F.col("node.first"))).alias("next"),
                                      F.count(F.lit(1)).alias("left"))
             .filter("next < last").select("key", "left"))
    return written(members.join(open_, "key"), f"open{turn}")


def removed_lines(rows: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS, short_lines: bool = False) -> DataFrame:
    """``(r1, r2, n_lines, n_removed, removed)`` for each row (``doc_id, body``) that has lines taking part."""
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    if min_chars < 2 * (distance + 1):
        raise ValueError("min_chars must be at least 2 * (distance + 1)")
    spark = rows.sparkSession
    folder = scratch_path(spark, f"lines-{uuid.uuid4().hex}")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    lines = lines_of(rows, min_chars, short_lines)
    line, own = F.col("line"), length_class(F.length("line"))
    next_ = length_class(F.length("line") + distance)
    long = F.length(line) >= min_chars
    keys = [F.when(long, k) for k in segment_keys(line, F.col("own"), distance)]
    keys += [F.when(long & (F.col("next") > F.col("own")), k) for k in segment_keys(line, F.col("next"), distance)]
    names = [f"k{n}" for n in range(len(keys))]
    # the keys depend on the line alone: any aggregate that keeps one will do, min of longs is hashed
    firsts = (lines.withColumns({"own": own, "next": next_}).select("h1", "h2", "place", *(k.alias(n) for k, n in zip(keys, names)))
              .groupBy("h1", "h2").agg(F.min("place").alias("first"), *(F.min(n).alias(n) for n in names)))
    firsts = written(firsts.select("h1", "h2", "first", F.array_distinct(F.array_compact(F.array(*names))).alias("keys")), "firsts")
    late = late_lines(lines, firsts, written, distance, min_chars)
    first = firsts.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first").join(late.select("first", F.col("h1").alias("f1"), F.lit(True).alias("late")), ["first", "f1"], "left")
    first = written(first, "judged")  # both sides of the join are plain shuffles, so a hot line can be split
    placed = lines.select("r1", "r2", "pos", "place", "h1", "h2").join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
    gone = F.col("late").isNotNull() | (F.col("place") != F.col("first"))
    # rows that are repeated as a whole hold each line as often
    return placed.groupBy("r1", "r2").agg(F.size(F.collect_set("pos")).cast("bigint").alias("n_lines"),
                                          F.array_sort(F.collect_set(F.when(gone, F.col("pos")))).alias("removed"))


def with_line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE,
                    min_chars: int = MIN_CHARS, short_lines: bool = False) -> DataFrame:
    """``docs`` with the text that stays, ``n_lines, n_removed`` and the ``removed`` line numbers."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = packed(docs, doc_id=F.col(doc_id), text=F.col(text), body=body)
    found = removed_lines(rows.select("doc_id", "body"), distance, min_chars, short_lines).withColumnsRenamed({"r1": "f1", "r2": "f2"})
    rows = rows.select("row", "text", *_row_digest()).join(found, (F.col("r1") == F.col("f1")) & (F.col("r2") == F.col("f2")), "left")
    rows = rows.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("removed"), i))
    rows = rows.withColumns({"left": F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(left, "\n")),
                             "n_lines": F.coalesce("n_lines", F.lit(0)).cast("bigint"), "n_removed": F.size("removed").cast("bigint")})
    return unpacked(rows, docs.columns, OUT, {text: F.col("left")})


@query("op10_edit_line_dedup")
def op10_edit_line_dedup(spark, sf_dir):
    out = with_line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), short_lines=True)
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))
