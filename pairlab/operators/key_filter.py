"""A persisted, mergeable filter of the keys a job has finished.

Hashes of the keys set bits of a bitmap of ``2 ** bits`` bits, kept as pages of 4 KB
(Spark's bitmap aggregate) in a hidden folder next to the output.  Each run merges its
keys by or.  A key whose bit is not set is surely new; only the others meet the finished
keys in an exact null-safe anti-join, and of the finished keys only those that
may be among them: both are tested against a bitmap whose size is fixed, so
neither old outputs nor new keys are shuffled whole.  A full bitmap lets
everything through to the exact join; results never change.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.operators.ranking import null_safe_join

BITS = 27  # 16 MB
PAGE_BITS = 15
SCHEMA = "page bigint, bits binary, rows bigint"
FOLDER = "_keys"


def _slot(keys: Sequence[str], bits: int) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << bits) - 1))


def key_pages(rows: DataFrame, keys: Sequence[str], bits: int = BITS) -> DataFrame:
    """``(page, bits)``: at most ``2 ** bits / 32768`` rows, pre-aggregated before the shuffle."""
    slot = rows.select(_slot(keys, bits).alias("s"))
    return slot.groupBy(F.shiftright("s", PAGE_BITS).alias("page")).agg(
        F.bitmap_construct_agg(F.col("s").bitwiseAND(F.lit((1 << PAGE_BITS) - 1))).alias("bits"))


def with_possible(rows: DataFrame, pages: DataFrame, keys: Sequence[str], bits: int = BITS, name: str = "_possible") -> DataFrame:
    """``rows`` with a flag: false if no key of the pages can be the row's."""
    slot = _slot(keys, bits)
    at = slot.bitwiseAND(F.lit((1 << PAGE_BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.substr("_page_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    known = pages.select(F.col("page").alias("_page"), F.col("bits").alias("_page_bits"))
    # bounded: 2 ** bits / 32768 pages of 4 KB
    return (rows.join(F.broadcast(known), F.shiftright(slot, PAGE_BITS) == F.col("_page"), "left")
            .withColumn(name, F.coalesce(held, F.lit(False))).drop("_page", "_page_bits"))


def filtered_anti_join(rows: DataFrame, done: DataFrame, keys: Sequence[str], pages: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows whose key is not among the done ones; ``pages`` covers all of ``done``."""
    keys = list(keys)
    marked = with_possible(rows, pages, keys, bits)
    hits = marked.filter("_possible").drop("_possible")
    near = with_possible(done.select(*keys), key_pages(hits, keys, bits), keys, bits).filter("_possible").drop("_possible")
    rest = null_safe_join(hits, near.distinct(), keys, "left_anti")
    return marked.filter(~F.col("_possible")).drop("_possible").unionByName(rest)


@dataclass(frozen=True)
class KeyFilter:
    """The filter stored next to an output folder."""

    spark: SparkSession
    out: str
    keys: tuple[str, ...]
    bits: int = BITS

    @property
    def _root(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(f"{self.out}/{FOLDER}")

    def _fs(self):
        return self._root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generations(self) -> list[int]:
        """Complete generations, oldest first."""
        fs, root = self._fs(), self._root
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[1:]) for n in names if n[:1] == "g" and n[1:].isdigit() and fs.exists(path(f"{self.out}/{FOLDER}/{n}/_SUCCESS")))

    def _read(self, generation: int) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.out}/{FOLDER}/g{generation}")

    def pages(self, done: DataFrame) -> DataFrame:
        """Pages that cover the whole output: the stored ones, or made anew if the
        output holds other rows than they were told of (someone else wrote to it)."""
        found = self._generations()
        if found:
            stored = self._read(found[-1])
            if (stored.filter("page = -1").agg(F.sum("rows")).first()[0] or 0) == done.count():  # footers only
                return stored.filter("page >= 0").select("page", "bits")
        self._write(key_pages(done, self.keys, self.bits), done.count())
        return self._read(self._generations()[-1]).filter("page >= 0").select("page", "bits")

    def merge(self, new: DataFrame, rows: int) -> None:
        """Adds the keys of ``new``, ``rows`` of them.  Called before they are written: should that
        fail, the counts differ and the filter is made anew."""
        found = self._generations()
        pages = key_pages(new, self.keys, self.bits)
        if found:
            stored = self._read(found[-1])
            pages = (stored.filter("page >= 0").select("page", "bits").unionByName(pages)
                     .groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits")))
            rows += stored.filter("page = -1").agg(F.sum("rows")).first()[0] or 0
        self._write(pages, rows)

    def _write(self, pages: DataFrame, rows: int) -> None:
        found = self._generations()
        next_ = (found[-1] if found else 0) + 1
        count = self.spark.createDataFrame([(-1, None, rows)], SCHEMA)
        (pages.select("page", "bits", F.lit(None).cast("bigint").alias("rows")).unionByName(count)
         .coalesce(8).write.mode("overwrite").parquet(f"{self.out}/{FOLDER}/g{next_}"))
        for old in found:
            self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{FOLDER}/g{old}"), True)
