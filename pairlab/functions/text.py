"""Column -> Column text functions.

All of these are built-in Spark expressions (JVM side, whole-stage codegen);
none calls Python.  Lengths are Unicode code points, words are runs of
non-whitespace (``str.split()`` semantics: no empty pieces).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlab.functions.tokenizers import _USER, PATTERNS, tokens

ColLike = Column | str


def _c(x: ColLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


NL = "\n"
WS_SPLIT = r"(?U)\s+"


def utrim(x: ColLike) -> Column:
    """Strip leading/trailing Unicode whitespace (Python ``str.strip()``)."""
    return F.regexp_replace(_c(x), r"^(?U)\s+|(?U)\s+$", "")


def has_text(x: ColLike) -> Column:
    """Whether a character that is no Unicode whitespace occurs (false for null)."""
    return F.coalesce(_c(x).rlike(r"(?U)\S"), F.lit(False))


def char_len(x: ColLike) -> Column:
    """Code points, as BIGINT."""
    return F.length(_c(x)).cast("bigint")


def word_list(x: ColLike) -> Column:
    """Whitespace words without empty pieces (``str.split()``)."""
    return F.filter(F.split(_c(x), WS_SPLIT), lambda t: t != "")


def word_len(x: ColLike) -> Column:
    """Whitespace word count (a match count: no array is materialised)."""
    return F.regexp_count(_c(x), F.lit(r"(?U)\S+")).cast("bigint")


def sentence_count(x: ColLike) -> Column:
    """Pieces between runs of ``.!?`` that are non-blank after strip."""
    pieces = F.split(_c(x), r"[.!?]+")
    return F.size(F.filter(pieces, has_text)).cast("bigint")


def token_len(x: ColLike, tokenizer: str = "wordpunct") -> Column:
    if tokenizer in PATTERNS and tokenizer not in _USER:
        return F.regexp_count(_c(x), F.lit(PATTERNS[tokenizer])).cast("bigint")
    return F.size(tokens(_c(x), tokenizer)).cast("bigint")


def compression_ratio(text_len: ColLike, summary_len: ColLike) -> Column:
    """text/summary; +inf when the summary length is 0 (ANSI-safe)."""
    t, s = _c(text_len).cast("double"), _c(summary_len).cast("double")
    return F.when(s == 0, F.lit(float("inf"))).otherwise(F.try_divide(t, s))


def first_line(x: ColLike) -> Column:
    """Text before the first newline; unchanged when there is none."""
    return F.substring_index(_c(x), NL, 1)


def after_first_line(x: ColLike) -> Column:
    """Text after the first newline; empty when there is none."""
    c = _c(x)
    pos = F.instr(c, NL)
    return F.when(pos == 0, F.lit("")).otherwise(F.substring(c, pos + 1, F.lit(2147483647)))


def split_first_line(x: ColLike) -> Column:
    """struct(before, after) where ``after`` is null without a newline."""
    c = _c(x)
    pos = F.instr(c, NL)
    return F.struct(first_line(c).alias("before"),
                    F.when(pos == 0, F.lit(None).cast("string"))
                    .otherwise(F.substring(c, pos + 1, F.lit(2147483647))).alias("after"))


def truncate_ellipsis(x: ColLike, n: int) -> Column:
    c = _c(x)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def truncate_always_ellipsis(x: ColLike, n: int) -> Column:
    return F.concat(F.left(_c(x), F.lit(n)), F.lit("..."))


def strip_prompt(full: ColLike, prompt: ColLike) -> Column:
    """``full[len(prompt):].strip()`` -- positional, the prefix is not checked."""
    f = _c(full)
    return utrim(F.substring(f, F.length(_c(prompt)) + 1, F.lit(2147483647)))


def response_after_marker(x: ColLike, marker: str = "### Response:") -> Column:
    """Part after the last ``marker`` (whole text when absent), stripped."""
    return utrim(F.substring_index(_c(x), marker, -1))


SENTENCE_BREAK = r"(?<=[.!?])(?U)\s+"


def sentences(x: ColLike) -> Column:
    """Split at whitespace that follows ``.``, ``!`` or ``?``."""
    return F.split(_c(x), SENTENCE_BREAK)


def sentence_distinct(pieces: Column) -> Column:
    """Set semantics over non-empty sentences keeping first occurrence order."""
    return F.array_distinct(F.filter(pieces, lambda t: t != ""))


def remove_repetitions(x: ColLike) -> Column:
    """Drop repeated sentences; unchanged when the text has <= 1 sentence."""
    c = _c(x)
    parts = sentences(c)
    return F.when(F.size(parts) <= 1, c).otherwise(F.concat_ws(" ", sentence_distinct(parts)))


def sentence_lines(x: ColLike) -> Column:
    """One sentence per line (``". "`` -> newline) before ROUGE-Lsum."""
    return F.replace(_c(x), F.lit(". "), F.lit(NL))


def article_url(host: ColLike, title: ColLike) -> Column:
    """``https://{host}/wiki/{title with spaces as underscores}``."""
    return F.concat(F.lit("https://"), _c(host), F.lit("/wiki/"),
                    F.replace(_c(title), F.lit(" "), F.lit("_")))


def article_id(title: ColLike, width: int = 10) -> Column:
    """First ``width`` hex digits of md5(utf-8 title)."""
    return F.substring(F.md5(_c(title)), 1, width)


def count_occurrences(x: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.try_divide(F.length(x) - F.length(F.replace(x, F.lit(needle), F.lit(""))),
                        F.lit(len(needle))).cast("bigint")


# Fixed values (must equal the reference's): indicator strings of a list-like
# filmography article, the infobox marker and the two thresholds.
FILM_INDICATORS = ["film)", "cinema)", "* [[", "filmographie", "acteur", "réalisateur"]
INFOBOX_MARKER = "{{Infobox"
INFOBOX_WINDOW = 500
FILM_INDICATOR_LIMIT = 10
BULLET_LIMIT = 15
INFOBOX_ISSUE = "Article starts with an infobox"
FILM_ISSUE = "Article may be primarily filmography (indicators: {n})"
BULLET_ISSUE = "Article has many bullet points ({n})"


def film_indicator_count(x: ColLike) -> Column:
    low = F.lower(_c(x))
    total = None
    for ind in FILM_INDICATORS:
        term = count_occurrences(low, ind)
        total = term if total is None else total + term
    return total


def article_quality_issues(x: ColLike) -> Column:
    """Array of issue messages (empty when the article looks fine)."""
    c = _c(x)
    films = film_indicator_count(c)
    stars = count_occurrences(c, "*")
    counted = lambda issue, n: F.replace(F.lit(issue), F.lit("{n}"), n.cast("string"))
    return F.array_compact(F.array(
        F.when(F.left(c, F.lit(INFOBOX_WINDOW)).contains(INFOBOX_MARKER), F.lit(INFOBOX_ISSUE)),
        F.when(films > FILM_INDICATOR_LIMIT, counted(FILM_ISSUE, films)),
        F.when(stars > BULLET_LIMIT, counted(BULLET_ISSUE, stars)),
    ))


def midtext_start_flag(x: ColLike, marker: str = "ession", window: int = 50) -> Column:
    return F.left(_c(x), F.lit(window)).contains(marker)


def copied_lead_flag(text: ColLike, summary: ColLike) -> Column:
    """Summary appears to start with the article's lead.

    t = strip(lower(text[:100])), s = strip(lower(summary[:100])) ('' for an
    empty summary); flag = (s != '' and t startswith s[:20]) or s startswith
    t[:20] -- the reference's operator precedence is kept on purpose.
    """
    t = utrim(F.lower(F.left(_c(text), F.lit(100))))
    s = utrim(F.lower(F.left(_c(summary), F.lit(100))))
    return ((s != "") & t.startswith(F.left(s, F.lit(20)))) | s.startswith(F.left(t, F.lit(20)))


def first_word_lower(x: ColLike) -> Column:
    """Lower-cased first whitespace word, null when there is none."""
    return F.lower(F.get(word_list(x), 0))


def prefix_text(x: ColLike, prefix: str) -> Column:
    return F.concat(F.lit(prefix), _c(x))
