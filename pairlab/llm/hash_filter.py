"""A bitmap of hashes of fixed size: thins rows out before an exact join.

A set bit may belong to another hash, so a kept row proves nothing; a dropped row
has no partner.  The size doesn't grow with the data: a bitmap that gets full
drops fewer rows, and results stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25  # 4 MB
_PAGE = 32768  # bits of one page of Spark's bitmap aggregate


_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all (splitmix finaliser)."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def bitmap_of(df: DataFrame, column: Column, bits: int = BITS) -> np.ndarray:
    """Bytes of the bitmap of a column of 64-bit hashes (``2 ** bits`` bits, however many rows)."""
    slot = column.bitwiseAND(F.lit((1 << bits) - 1))
    pages = (df.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("page"))
             .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(_PAGE - 1))).alias("bits")))
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for row in pages.collect():  # at most 2 ** bits / 32768 pages of 4 KB
        part = np.frombuffer(row["bits"], np.uint8)[: len(out)]
        out[row["page"] * (_PAGE // 8): row["page"] * (_PAGE // 8) + len(part)] = part
    return out


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be among those of the bitmap."""
    slot = hashes.astype(np.uint64, copy=False) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
