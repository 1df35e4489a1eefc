"""Secret scans with multipart credential linking (operator 1), DataFrame functions only.

Every text is scanned for base secrets, which always stay, and for weak parts:
identifiers (client_id=..., user: ...), secret-looking tokens and endpoints.
A match's place comes from the text between matches: splitting by the pattern
gives the gaps, and running sums of gaps and matches give the starts.

Scopes are overlapping stretches of ``2 * SCOPE`` characters, one each ``SCOPE``
characters; parts are interval-joined with the scopes that hold their start, and
the roles in each scope (identity, secret, endpoint) are pre-aggregated.  A weak
identifier is reported where a secret co-occurs, a weak token where an identity or
an endpoint does, an endpoint where both an identity and a secret do.  Weak parts
that overlap a base span are not reported; of overlapping weak parts the one that
starts first stays (the earlier listed kind at the same start), and one that is
dropped for it hides no other.

Only matches are shuffled, by document (id and text digest), never texts; the
work is linear in the matches, and no pairs are emitted.

Defined results: a null or empty text has no spans; rows with equal id and text
get the same result each, rows with null ids theirs; an empty table gives no rows;
other columns pass through, those called like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.packing import packed, unpacked
from pairlab.llm.registry import query, read
from pairlab.session import cut_lineage

SCOPE = 400
OUT = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]

# fixed values: kind -> pattern, the group that counts and its least length
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
WEAK = {
    "identity": (r"(?i:client_?id|user_?name|user|login|account_?id|access_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})", 1, 3),
    "key": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24),
    "endpoint": (r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{4,}", 0, 8),
}
KINDS = [*BASE, *WEAK]
ROLE = {"assign": "secret", "access": "identity", "hex": "secret", "identity": "identity", "key": "secret", "endpoint": "endpoint"}


def _matches(text: Column, kind: str) -> Column:
    """Array of (gap before, match, counted group) of the pattern's matches."""
    pattern, group, _ = (BASE | WEAK)[kind]
    zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
                          F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("size"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    return F.when(text.rlike(pattern), zipped)


def _accepted(kind: Column, part: Column) -> Column:
    ok = F.lit(False)
    for k, (_, _, least) in (BASE | WEAK).items():
        good = F.length(part) >= least
        if k == "key":  # mixed letters and digits, not a word or a path
            good = good & part.rlike("[0-9]") & part.rlike("[A-Z]") & part.rlike("[a-z]")
        ok = F.when(kind == k, good).otherwise(ok)
    return ok


def _lookup(kind: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def parts_of(keyed: DataFrame) -> DataFrame:
    """``(key, text)`` -> accepted parts ``(key, kind, start, end)``, hash-partitioned by key."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), _matches(F.col("text"), k).alias("found")) for k in KINDS))
    rows = (keyed.select("key", F.explode(each).alias("e")).filter("e.found is not null")
            .select("key", "e.kind", F.posexplode("e.found").alias("i", "m"))
            .select("key", "kind", "i", "m.gap", F.coalesce("m.size", F.lit(0)).alias("size"), "m.part"))
    # one set of matches for rows with equal id and text, combined before the shuffle; all steps below keep the second partitioning
    rows = rows.dropDuplicates(["key", "kind", "i"]).repartition("key")
    before = Window.partitionBy("key", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    return rows.filter(F.col("part").isNotNull() & _accepted(F.col("kind"), F.col("part"))).select("key", "kind", "start", "end")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base parts and the weak ones whose complementary parts share a scope."""
    k = F.col("kind")
    parts = parts.withColumn("base", k.isin(*BASE)).withColumn("rank", _lookup(k, {x: i for i, x in enumerate(KINDS)}))
    by_start = Window.partitionBy("key").orderBy("start", "rank")
    past = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    hidden = (F.coalesce(past, F.lit(-1)) > F.col("start")) | (F.coalesce(coming, F.col("end")) < F.col("end"))
    parts = parts.withColumn("hidden", hidden).filter("base or not hidden")
    tile = F.floor(F.col("start") / scope)
    placed = parts.select("*", F.explode(F.array(tile - 1, tile)).alias("scope"))
    inside = Window.partitionBy("key", "scope")
    for r in ("identity", "secret", "endpoint"):
        placed = placed.withColumn(f"has_{r}", F.max(_lookup(k, ROLE) == r).over(inside))
    joined = (F.when(k == "identity", F.col("has_secret")).when(k == "key", F.col("has_identity") | F.col("has_endpoint"))
              .when(k == "endpoint", F.col("has_identity") & F.col("has_secret")).otherwise(True))
    found = placed.groupBy("key", "kind", "rank", "base", "start", "end").agg(F.max(joined).alias("linked")).filter("linked")
    past = F.max(F.when(~F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    # greedy in each run of overlapping parts, so that a dropped part hides no later one; no base span lies inside a run
    opens = F.when(F.col("base") | past.isNull() | (past <= F.col("start")), 1).otherwise(0)
    runs = (found.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("key", "run").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "base", "end"))).alias("parts")))

    def take(so_far: Column, p: Column) -> Column:
        stays = p["base"] | (p["start"] >= so_far["end"])
        return F.struct(F.when(stays, p["end"]).otherwise(so_far["end"]).alias("end"),
                        F.when(stays, F.concat(so_far["kept"], F.array(p))).otherwise(so_far["kept"]).alias("kept"))

    none = F.struct(F.lit(-1).cast("bigint").alias("end"), F.slice("parts", 1, 0).alias("kept"))
    kept = F.aggregate("parts", none, take, lambda a: a["kept"])
    return runs.select("key", F.explode(kept).alias("p")).select("key", "p.kind", "p.rank", "p.base", "p.start", "p.end")


def with_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """``docs`` with the base counts, ``base_sha256`` and ``spans`` (``kind:start:end`` by start, then kind)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    told = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    # the length of the id keeps ids with colons apart
    key = F.md5(F.concat_ws(":", F.when(F.col(doc_id).isNull(), F.lit("null")).otherwise(F.length(told).cast("string")), told, whole))
    found = linked(parts_of(docs.select(key.alias("key"), whole.alias("text"))), scope)
    label = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    span = F.struct("start", "rank", label.alias("label"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["label"]), ",")
    found = found.groupBy("key").agg(
        *(F.count_if(F.col("kind") == b).alias(f"n_{b}") for b in BASE),
        joined(F.collect_list(F.when(F.col("base"), span))).alias("base_spans"), joined(F.collect_list(span)).alias("spans"))
    found = cut_lineage(found.withColumnRenamed("key", "found"))  # a plain shuffle in the join, so that a hot row can be split
    rows = packed(docs, own=key).join(found, F.col("own") == F.col("found"), "left")
    rows = rows.select("row", *(F.coalesce(f"n_{b}", F.lit(0)).cast("bigint").alias(f"n_{b}") for b in BASE),
                       F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
    return unpacked(rows, docs.columns, OUT)


@query("op1_secret_scan")
def op1_secret_scan(spark, sf_dir):
    return with_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
