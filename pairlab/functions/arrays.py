"""Array column functions for training examples (token ids, labels, masks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_INDEX = -100  # label value the loss ignores


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mask_prompt_labels(ids, prompt_len) -> Column:
    """labels = [-100] * p + ids[p:], then cut to len(ids).

    ``prompt_len`` is the (already truncated) prompt token count.
    """
    ids, p = _c(ids), _c(prompt_len)
    n = F.size(ids)
    rest = F.when(p < n, F.slice(ids, p + 1, n)).otherwise(F.array().cast("array<int>"))
    masked = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.least(p, n)), rest)
    return F.slice(masked, 1, n)


def attention_mask(ids) -> Column:
    """Ones, one per id."""
    return F.array_repeat(F.lit(1), F.size(_c(ids)))


def pad_labels(ids, max_len: int, pad_id: int, ignore_pad: bool = True) -> Column:
    """Right-pad (or cut) to ``max_len`` with ``pad_id``; pad positions become
    -100 when ``ignore_pad`` (so the loss skips them)."""
    ids = _c(ids)
    padded = F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(max_len) - F.size(ids), F.lit(0)))),
                     1, max_len)
    if not ignore_pad:
        return padded
    return F.transform(padded, lambda x: F.when(x == pad_id, F.lit(IGNORE_INDEX)).otherwise(x))


def unmask_labels(labels, pad_id: int) -> Column:
    """-100 -> pad id (before decoding)."""
    return F.transform(_c(labels), lambda x: F.when(x == IGNORE_INDEX, F.lit(pad_id)).otherwise(x))


def join_ints(arr) -> Column:
    """Comma-joined text form of an int array (for flat outputs)."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), ",")
