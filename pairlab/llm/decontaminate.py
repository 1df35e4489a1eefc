"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 5).

The patterns are the benchmark items' windows (``window`` consecutive words, or
a whole shorter item), grouped by length.  For each length a shift table over
two-word blocks tells how far the search may jump after reading the block at
the end of the current window; where the shift is zero, the hash of the window's
suffix names a bucket of patterns, and comparing the words directly confirms an
occurrence.  Words are compared as numbers of the benchmark's own vocabulary.

The benchmark goes to the tasks in blocks cut by running counts of characters, at most
``block_words`` words and one item each (an item is never split), one pass over the
documents for each block; a pass adds the hit spans and item ids of its block to
the row and is written before the next block is read, so driver and tasks hold one block's
tables at a time, however large the benchmark.

Defined results: a null or blank text has no words and no hits; benchmark rows
without words are no patterns, those with a null id hit without a name; rows with the same id are one
item; an empty benchmark hits nothing; document rows are judged one by one,
whatever their ids; other columns pass through, those called like an output
are replaced.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.packing import packed, unpacked
from pairlab.llm.registry import query, read
from pairlab.operators.ranking import prefix_scan
from pairlab.session import scratch_path

WINDOW = 10
BLOCK = 2  # words in a block of the shift table
BLOCK_WORDS = 2_000_000
_word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_lower = {c: c + 32 for c in range(65, 91)}
OUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"]


def words_of(text: str | None) -> list[str]:
    return _word.findall((text or "").translate(_lower))


class Patterns:
    """Shift tables and suffix buckets of one block of benchmark items."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1) if size else ():
                owners.setdefault(tuple(ids[i:i + size]), set()).update([] if item is None else [item])
        self.by_length = {}
        for size in sorted({len(p) for p in owners}):
            mine = {p: sorted(o) for p, o in owners.items() if len(p) == size}
            block = min(BLOCK, size)
            shift: dict[tuple[int, ...], int] = {}
            bucket: dict[tuple[int, ...], dict] = {}
            for p in mine:
                for end in range(block, size + 1):
                    key = p[end - block:end]
                    shift[key] = min(shift.get(key, size), size - end)
                bucket.setdefault(hash(p[-block:]), {})[p] = mine[p]
            self.by_length[size] = (block, size - block + 1, shift, bucket)

    def search(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans (first word, end) and the items that occur."""
        find = self.vocabulary.get
        ids = [find(w, -1) for w in words]
        spans, items = [], set()
        for size, (block, most, shift, bucket) in self.by_length.items():
            end, n = size, len(ids)
            while end <= n:
                key = tuple(ids[end - block:end])
                step = shift.get(key, most)
                if step == 0:
                    window = tuple(ids[end - size:end])
                    found = bucket.get(hash(key), {}).get(window)  # dict lookup compares the words
                    if found is not None:
                        spans.append((end - size, end))
                        items.update(found)
                    step = 1
                end += step
        return spans, items


def _merge(spans: Iterable[tuple[int, int]]) -> list[int]:
    """Union of spans as a flat list start, end, start, end ..."""
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())),
                       T.StructField("items", T.ArrayType(T.StringType()))])


def _searcher(patterns: Patterns):
    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, before in batches:
            rows = []
            for text, spans, items in zip(texts, before["spans"], before["items"]):
                words = words_of(text)
                got, names = patterns.search(words)
                if got:
                    spans = _merge([*got, *zip(spans[::2], spans[1::2])])
                    items = sorted({*names, *items})
                rows.append((len(words), np.asarray(spans, np.int32), list(items)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])
    return search


def with_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated, item_ids``."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    spark = docs.sparkSession
    folder = scratch_path(spark, f"decontaminate-{uuid.uuid4().hex}")
    # a word and the mark after it take two characters at least
    blocks = 2 * block_words
    chars = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    if chars > blocks:
        spread = F.xxhash64("item", "text")
        sized = items.withColumns({"chars": F.length("text") + 1, "spread": spread})
        sized = prefix_scan(sized, [], [F.col("spread"), F.col("item"), F.col("text")], F.shiftright("spread", 52), "chars", "sum", "before")
        sized.select("item", "text", F.floor(F.coalesce("before", F.lit(0)) / blocks).cast("int").alias("block")).write.partitionBy("block").parquet(f"{folder}/items")
        items = spark.read.parquet(f"{folder}/items")
    state = F.struct(F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<int>").alias("spans"),
                     F.array().cast("array<string>").alias("items"))
    out = packed(docs, text=F.col(text), f=state)
    n = -(-chars // blocks) or 1
    for k in range(n):
        part = items.filter(F.col("block") == k) if n > 1 else items
        patterns = Patterns(((r.item, r.text) for r in part.select("item", "text").toLocalIterator()), window)
        out = out.withColumn("f", _searcher(patterns)("text", "f"))
        if k < n - 1:  # written, so that only one block's tables are alive
            out.write.parquet(f"{folder}/pass{k}")
            out = spark.read.parquet(f"{folder}/pass{k}")
    return unpacked(out.select("row", *_summary(F.col("f"))), docs.columns, OUT)


def _summary(f) -> list:
    spans, items = f["spans"], f["items"]
    signed = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"),
                         lambda a, x: a + x)
    return [f["n_words"].alias("n_words"), signed.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
            (F.size(spans) > 0).alias("contaminated"), F.array_sort(items).alias("item_ids")]


_SQL = f"""
with low as (select 'd' as side, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
             union all
             select 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
e as (select side, id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from low),
w as (select side, id, len(ws) as n, unnest(ws) as w, generate_subscripts(ws, 1) as i from e),
sizes as (select distinct least({WINDOW}, n) as m from w where side = 'b'),
g as (select w.side, w.id, w.n, s.m, w.i, string_agg(w.w, ' ') over (partition by w.side, w.id, s.m order by w.i rows between current row and {WINDOW - 1} following) as long_gram,
             w.w from w cross join sizes s),
gram as (select side, id, n, m, i, array_to_string(list_slice(string_split(long_gram, ' '), 1, m), ' ') as gram from g where i + m - 1 <= n),
pattern as (select distinct id as item, gram, m from gram where side = 'b' and m = least({WINDOW}, n)),
hit as (select x.id, x.i, x.m, p.item from gram x join pattern p on x.gram = p.gram and x.m = p.m where x.side = 'd'),
place as (select distinct id, unnest(generate_series(i, i + m - 1)) as i from hit),
hits as (select id, count(*) as n_hit from place group by id),
named as (select id, count(distinct item::varchar) as n_items, string_agg(distinct item::varchar, ',' order by item::varchar) as names from hit group by id)
select e.id as doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from e left join hits using (id) left join named using (id) where e.side = 'd'
"""


@query("op5_decontaminate", _SQL)
def op5_decontaminate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return with_contamination(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
