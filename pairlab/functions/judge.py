"""Parsing judge responses into two scores (Column -> struct).

Ordered fallback, all as JVM expressions (no Python):

1. every ``{...}`` block that mentions ``"score_a"`` then ``"score_b"`` (if
   there is none: the ``summary_a_score`` / ``summary_b_score`` form); the
   first block that parses as JSON and has both keys wins; values are
   kept as given (no 1..5 check, null stays null), explanation defaults to "";
2. ``Summary A ... <1-5> ... Summary B ... <1-5>`` on one line
   -> "Extracted from text";
3. all digit runs: with at least two, those within 1..5 are kept and with
   at least two kept the first two are used -> "Extracted numeric values";
4. null, null, "Failed to parse response".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's patterns and messages.
JSON_AB = r'\{[\s\S]*?"score_a"[\s\S]*?"score_b"[\s\S]*?\}'
JSON_SUMMARY_AB = r'\{[\s\S]*?"summary_a_score"[\s\S]*?"summary_b_score"[\s\S]*?\}'
TEXT_AB = r"[Ss]ummary [Aa].*?([1-5]).*?[Ss]ummary [Bb].*?([1-5])"
DIGITS = r"([0-9]+)"
MSG_TEXT = "Extracted from text"
MSG_NUMERIC = "Extracted numeric values"
MSG_FAILED = "Failed to parse response"

_SCHEMA = ("score_a STRING, score_b STRING, summary_a_score STRING, summary_b_score STRING, "
           "explanation STRING, _corrupt_record STRING")
_FIELDS = ["score_a", "score_b", "summary_a_score", "summary_b_score", "explanation", "_corrupt_record"]
# Strict JSON like Python's json module: no single quotes, and a malformed
# block is rejected as a whole (no partially parsed fields).
_JSON_OPTS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE",
              "columnNameOfCorruptRecord": "_corrupt_record"}


def parse_judge_scores(response: Column | str) -> Column:
    """struct(score_a DOUBLE, score_b DOUBLE, explanation STRING, path STRING)."""
    r = F.col(response) if isinstance(response, str) else response
    ab = F.regexp_extract_all(r, F.lit(JSON_AB), F.lit(0))
    sab = F.regexp_extract_all(r, F.lit(JSON_SUMMARY_AB), F.lit(0))
    blocks = F.when(F.size(ab) > 0, ab).otherwise(sab)
    # a map tells a null value from a missing key, the struct holds the values
    parsed = F.transform(blocks, lambda b: F.struct(
        F.from_json(b, _SCHEMA, _JSON_OPTS).alias("v"), F.map_keys(F.from_json(b, "map<string,string>", _JSON_OPTS)).alias("k")))
    parsed = F.transform(parsed, lambda p: F.struct(*(p["v"][c].alias(c) for c in _FIELDS), p["k"].alias("keys")))

    def has_ab(p):
        return F.array_contains(p["keys"], "score_a") & F.array_contains(p["keys"], "score_b")

    def has_sab(p):
        return F.array_contains(p["keys"], "summary_a_score") & F.array_contains(p["keys"], "summary_b_score")

    good = F.filter(parsed, lambda p: p["keys"].isNotNull() & p["_corrupt_record"].isNull() & (has_ab(p) | has_sab(p)))
    first = F.get(good, 0)
    j_a = F.when(has_ab(first), first["score_a"]).otherwise(first["summary_a_score"])
    j_b = F.when(has_ab(first), first["score_b"]).otherwise(first["summary_b_score"])
    j_ok = first.isNotNull()

    text_ab = "(?d)" + TEXT_AB  # a dot stops at a line feed only
    t_ok = r.rlike(text_ab)
    t_a = F.regexp_extract(r, text_ab, 1)
    t_b = F.regexp_extract(r, text_ab, 2)

    nums = F.regexp_extract_all(r, F.lit(DIGITS), F.lit(1))
    small = F.filter(nums, lambda x: x.try_cast("double").between(1, 5))
    n_ok = (F.size(nums) >= 2) & (F.size(small) >= 2)

    a = (F.when(j_ok, j_a.try_cast("double")).when(t_ok, t_a.try_cast("double"))
         .when(n_ok, F.get(small, 0).try_cast("double")))
    b = (F.when(j_ok, j_b.try_cast("double")).when(t_ok, t_b.try_cast("double"))
         .when(n_ok, F.get(small, 1).try_cast("double")))
    expl = (F.when(j_ok, F.coalesce(first["explanation"], F.lit(""))).when(t_ok, F.lit(MSG_TEXT))
            .when(n_ok, F.lit(MSG_NUMERIC)).otherwise(F.lit(MSG_FAILED)))
    path = (F.when(j_ok, F.lit("json")).when(t_ok, F.lit("text")).when(n_ok, F.lit("numeric"))
            .otherwise(F.lit("failed")))
    return F.struct(a.alias("score_a"), b.alias("score_b"), expl.alias("explanation"), path.alias("path"))


def judge_improvement(base: Column | str, tuned: Column | str) -> Column:
    """tuned - base; null when either is null."""
    b = F.col(base) if isinstance(base, str) else base
    t = F.col(tuned) if isinstance(tuned, str) else tuned
    return t - b


def in_range(score: Column | str, lo: int = 1, hi: int = 5) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return s.between(lo, hi)
