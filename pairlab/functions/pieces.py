"""Small pieces of Arrow batches.

Spark hands a Python step up to 10000 rows at once; as Python objects and work
arrays they take many times their Arrow size.  A step that goes through a batch
piece by piece holds these for one piece, whatever the batch and the table hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa

PIECE_BYTES = 1 << 20

Rows = TypeVar("Rows", pa.Array, pa.RecordBatch)


def pieces(rows: Rows, most: int = PIECE_BYTES) -> Iterator[Rows]:
    """``rows`` in order, in slices of at most ``most`` bytes each (a larger row alone)."""
    if len(rows) <= 1 or rows.nbytes <= most:
        yield rows
        return
    half = len(rows) // 2
    yield from pieces(rows.slice(0, half), most)
    yield from pieces(rows.slice(half), most)
