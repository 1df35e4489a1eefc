"""Carry a caller's columns through an operator as one struct, so that no name of theirs can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "row"


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` as the struct ``row`` and the named columns an operator works on."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(ROW), *(c.alias(n) for n, c in columns.items()))


def unpacked(df: DataFrame, names: list[str], out: list[str], replaced: dict[str, Column] | None = None) -> DataFrame:
    """The caller's columns ``names`` out of the struct, then ``out``; a caller's column of such a name gives way."""
    new = replaced or {}
    kept = [new.get(c, F.col(ROW).getField(c)).alias(c) for c in names if c not in out]
    return df.select(*kept, *(F.col(c) for c in out))
