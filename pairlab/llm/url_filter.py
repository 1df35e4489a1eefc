"""URL filter rules by hashed expressions (operator 6), DataFrame functions only.

Each distinct (host, path) is expanded into host suffixes and path prefixes (up
to the most labels and slashes that any rule has, so nothing is lost), the
expressions are equi-joined with the rules on a short prefix of their digest,
and the full digest, then the rest of the rule's path, confirm a match.  A rule
whose path stops inside a segment is filed under its last slash.  The longest
rule wins, then the one with the longer host, then block before allow, then the
smaller text.  Pages are joined back on (host, path); an expression or an address
shared by a third of the pages is one row in the search, and a skewed key in the
join back, which Spark's skew handling splits.

Defined results: a null address or one without ``://`` has an empty host and
path, which no rule fits; an empty path fits no rule whose path begins with a
slash; rules with a null host or path are ignored, a rule given twice is one
rule; page rows are judged one by one, whatever their ids; other columns pass
through, those called like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm.packing import packed, unpacked
from pairlab.llm.registry import query, read

# fixed values of the query's rules: verdict, host, path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SHORT = 8  # hex digits of the digest prefix in the join
OUT = ["host", "path", "rule", "verdict"]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _filed(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Host suffix + path prefix strings of one address."""
    suffixes = F.transform(F.sequence(F.lit(1), F.least(_count(host, ".") + 1, F.lit(labels))),
                           lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    deep = F.least(_count(path, "/"), F.lit(slashes))
    prefixes = F.transform(F.sequence(F.lit(0), deep), lambda k: F.when(k == 0, "").otherwise(
        F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def with_verdict(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; ``rules`` is ``(verdict, host, path)``."""
    rules = rules.select("verdict", "host", "path").filter("host is not null and path is not null").distinct()
    most = rules.agg(F.max(_count(F.col("host"), ".") + 1), F.max(_count(F.col("path"), "/"))).first()
    digest = F.sha2(F.concat("r_host", _filed(F.col("r_path"))), 256)
    book = (rules.select(F.col("verdict").alias("r_verdict"), F.col("host").alias("r_host"), F.col("path").alias("r_path"))
            .withColumn("r_digest", digest).withColumn("r_short", F.substring("r_digest", 1, SHORT)))
    rows = packed(pages, host=host_of(F.col(url)), path=path_of(F.col(url)))
    places = rows.select("host", "path").distinct()
    found = (places.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), most[0] or 1, most[1] or 0)).alias("e"))
             .withColumn("digest", F.sha2("e", 256)).withColumn("short", F.substring("digest", 1, SHORT)).drop("e"))
    rule = F.concat("r_host", "r_path")
    fits = found.join(book, (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path")))
    best = fits.groupBy("host", "path").agg(F.max_by(
        F.struct(rule.alias("rule"), F.col("r_verdict").alias("verdict")),
        F.struct(F.length(rule), F.length("r_host"), F.col("r_verdict") == "block")).alias("best"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best")
    rows = (rows.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
            .select("row", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
    return unpacked(rows, pages.columns, OUT)


def rule_table(spark: SparkSession, rules=tuple(RULES)) -> DataFrame:
    rows = [F.struct(*(F.lit(v).alias(c) for v, c in zip(r, ("verdict", "host", "path")))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


_SQL = r"""
with u as (select page_id,
                  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path from pages),
r(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
select page_id, host, path,
       (select h || p from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
       coalesce((select verdict from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1), 'allow') as verdict
from u"""


@query("op6_url_filter", _SQL)
def op6_url_filter(spark, sf_dir):
    return with_verdict(read(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).drop("url")
