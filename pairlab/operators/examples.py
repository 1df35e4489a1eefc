"""Training-example construction: vocabulary, token ids, masked labels,
length buckets.

Tokenisation makes one row per (text, distinct token) with its positions + an
equi-join with the vocabulary (Spark picks a broadcast when the vocabulary is
measured small, otherwise a shuffle join whose hot tokens are split by AQE's skew
handling) + one group per text that puts the ids back in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from pairlab.functions import arrays as A
from pairlab.functions.pieces import pieces
from pairlab.functions.text import token_len
from pairlab.functions.tokenizers import tokens
from pairlab.operators.radix import descending, radix_prefixes
from pairlab.operators.ranking import ranked
from pairlab.session import cut_lineage

PAD, UNK = "<pad>", "<unk>"
PAD_ID, UNK_ID = 0, 1
N_SPECIAL = 2


def build_vocab(df: DataFrame, col: str = "text", tokenizer: str = "wordpunct") -> DataFrame:
    """(token, id, n): ids by descending count then token, after the special
    tokens ``<pad>``=0 and ``<unk>``=1.

    Counting is a partial aggregate; the global ranking is two-level.  Its buckets
    are the leaves of a trie over (descending count, token) that is split by
    measured counts, so neither the long tail of tokens seen once nor
    tokens that share a start fall into one task.
    """
    counts = cut_lineage(df.select(F.explode(tokens(F.col(col), tokenizer)).alias("token"))
                         .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    keyed = radix_prefixes(counts.withColumn("_k", descending("n", "token")), "_k", name="_leaf")
    r = ranked(keyed.drop("_k"), [], [F.col("n").desc(), F.col("token")], F.col("_leaf"), name="_r")
    return r.select("token", (F.col("_r") - 1 + N_SPECIAL).cast("int").alias("id"), "n")


def _distinct_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, tokens) -> (row, token, positions), one row per distinct token of a row; (row, null, []) without tokens."""
    for batch in (piece for whole in batches for piece in pieces(whole)):
        lists = batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        parents = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(parents)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        words = pc.list_flatten(lists).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(parents * np.int64(len(words.dictionary) + 1) + codes, kind="stable")
        parents, codes, place = parents[order], codes[order], place[order]
        starts = np.flatnonzero(np.r_[True, (parents[1:] != parents[:-1]) | (codes[1:] != codes[:-1])][: len(codes)])
        offsets = pa.array(np.r_[starts, len(codes)].astype(np.int32))
        none = np.flatnonzero(lengths == 0)
        rows = batch.column(0).take(pa.array(np.r_[parents[starts], none]))
        token = pa.concat_arrays([words.dictionary.take(pa.array(codes[starts])).cast(pa.string()), pa.nulls(len(none), pa.string())])
        positions = pa.concat_arrays([pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))),
                                      pa.array([[]] * len(none), pa.list_(pa.int32()))])
        yield pa.RecordBatch.from_arrays([rows, token, positions], names=["row", "token", "positions"])


def tokenize(df: DataFrame, keys: Sequence[str], col: str, vocab: DataFrame, max_len: int | None = None,
             tokenizer: str = "wordpunct", out: str = "input_ids", carry: Sequence[str] = ()) -> DataFrame:
    """keys + ``out`` (ARRAY<INT>): token ids in text order, cut to
    ``max_len``; unknown tokens map to ``<unk>``.  ``carry`` names small columns
    of a row that go along."""
    keys, carry = list(keys), list(carry)
    toks = tokens(F.col(col), tokenizer)
    if max_len is not None:  # only kept tokens become rows
        toks = F.slice(toks, 1, max_len)
    rows = df.select(F.struct(*keys, *carry).alias("row"), toks.alias("tokens"))
    each = rows.mapInArrow(_distinct_tokens, TT.StructType([rows.schema["row"]]).add("token", TT.StringType()).add("positions", TT.ArrayType(TT.IntegerType())))
    j = each.join(vocab.select("token", "id"), "token", "left")
    j = j.select("row.*", F.coalesce("id", F.lit(UNK_ID)).alias("_id"), "positions")
    g = j.groupBy(*keys).agg(*(F.first(c).alias(c) for c in carry), F.collect_list(F.struct("positions", "_id")).alias("_s"))
    placed = F.flatten(F.transform("_s", lambda s: F.transform(s["positions"], lambda p: F.struct(p.alias("pos"), s["_id"].alias("id")))))
    return g.select(*keys, *carry, F.transform(F.sort_array(placed), lambda s: s["id"]).alias(out))


def decode(df: DataFrame, keys: Sequence[str], ids: str, vocab: DataFrame, out: str = "text",
           skip_special: bool = True) -> DataFrame:
    """ids -> space-joined tokens (special tokens skipped)."""
    keys = list(keys)
    ex = df.select(*keys, F.posexplode_outer(ids).alias("pos", "id"))
    if skip_special:
        ex = ex.filter(F.col("id").isNull() | (F.col("id") >= N_SPECIAL))
    j = ex.join(vocab.select("id", "token"), "id", "left")
    g = j.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_s"))
    return g.select(*keys, F.array_join(F.transform("_s", lambda s: s["token"]), " ").alias(out))


def mask_prompt_labels(df: DataFrame, keys: Sequence[str], prompt: str, full: str, vocab: DataFrame,
                       max_len: int, max_target: int, tokenizer: str = "wordpunct") -> DataFrame:
    """input_ids = tok(full)[:max_len + max_target]; labels mask the first
    len(tok(prompt)[:max_len]) positions with -100; attention mask of ones."""
    keys = list(keys)
    p = F.least(token_len(F.col(prompt), tokenizer), F.lit(max_len)).cast("int")
    j = tokenize(df.withColumn("_p", p), keys, full, vocab, max_len + max_target, tokenizer, "input_ids", ["_p"])
    return j.select(*keys, "input_ids", A.attention_mask("input_ids").alias("attention_mask"),
                    A.mask_prompt_labels("input_ids", "_p").alias("labels"))


def length_buckets(df: DataFrame, length: str, size: int, multiple: int = 8, by: Sequence[str] = (),
                   key: str | None = None) -> DataFrame:
    """Batches of rows of similar length; per batch the padded length
    (batch max rounded up to ``multiple``) and the padding waste.

    Rows are ranked by length (two-level rank, bucketed on the length),
    cut into consecutive batches of ``size``, then aggregated per batch.
    """
    from pairlab.operators.ranking import balanced_bucket
    by = list(by)
    order = [F.col(length)] + ([F.col(key)] if key else [])
    # many rows share a length: the bucket also splits a length by key prefix; a class is one length,
    # so that a window holds the prefixes of one length or the lengths, never both
    bucket = (F.struct(F.col(length).cast("bigint").alias("len"), F.substring(F.col(key).cast("string"), 1, 3).alias("k"))
              if key else balanced_bucket(df, length))
    r = ranked(df, by, order, bucket, name="_pos",
               coarse=(lambda b: b["len"]) if key else None)
    b = r.withColumn("batch", F.floor((F.col("_pos") - 1) / size).cast("bigint"))
    agg = b.groupBy(*by, "batch").agg(F.count(F.lit(1)).alias("rows"), F.max(length).alias("max_len"),
                                      F.sum(length).alias("total_len"))
    padded = (F.ceil(F.col("max_len") / F.lit(multiple)) * F.lit(multiple)).cast("bigint")
    return agg.select(*by, "batch", "rows", padded.alias("padded_len"),
                      (F.col("rows") * padded - F.col("total_len")).cast("bigint").alias("padding_waste"))
