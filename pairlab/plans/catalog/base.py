"""Registry of named queries: a Spark builder and (optionally) oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame computed over
whole driver tables (or tables Spark derives from them).  The oracle SQL is
plain DuckDB/ANSI SQL over the same tables; queries without an SQL
equivalent (LCS, stateful/iterative work) register ``sql=None`` and are
covered by exact pytest goldens instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.plans import fixtures
from pairlab.sources.tables import Tables

Builder = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(Tables(spark, sf_dir)))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        REGISTRY[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


SCALE = float(10 ** DIGITS)


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every DOUBLE column for engine-independent comparison.

    ``floor(x * 1e6 + 0.5) / 1e6`` is the same IEEE computation in Spark and
    DuckDB (``round`` is not: Spark rounds the decimal string, DuckDB the
    binary value, so ties such as 323/640 differ).  Non-finite values pass.
    """
    scale = float(10 ** digits)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.col(f.name).cast("double")
            finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
            cols.append(F.when(finite, F.floor(x * scale + 0.5) / scale).otherwise(x).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rsql(sql: str, doubles: str = "", fixtures_used: tuple[str, ...] = ()) -> str:
    """Wrap oracle SQL: add fixture CTEs and round the named DOUBLE columns."""
    body = fixtures.with_fixtures(sql, *fixtures_used) if fixtures_used else sql
    names = [c.strip() for c in doubles.split(",") if c.strip()]
    if not names:
        return body
    repl = ", ".join(
        f"case when isnan(cast({c} as double)) or isinf(cast({c} as double)) then cast({c} as double) "
        f"else floor(cast({c} as double) * {SCALE!r} + 0.5) / {SCALE!r} end as {c}" for c in names)
    return f"select * replace ({repl}) from (\n{body}\n) q"
