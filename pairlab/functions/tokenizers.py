"""Built-in tokenizers (Column -> ARRAY<STRING>) and the user tokenizer slot.

The reference delegates tokenisation to model tokenizers that are not part
of its tree; here a tokenizer is a name for a JVM-side regex split, or a
user-supplied vectorised function plugged in through ``tokenizer_udf``.

Built-ins (all patterns behave the same in Java regex and RE2, so the
DuckDB oracle can reproduce them):

* ``whitespace`` -- runs of non-whitespace (``str.split()``)
* ``word``       -- lower-cased runs of letters/digits (punctuation dropped);
                    the default for ROUGE, following the published metric
* ``wordpunct``  -- runs of letters/digits/underscore, or a single other
                    non-space character; the default token count
* ``char``       -- every non-whitespace code point (scripts without spaces)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.pieces import pieces

PATTERNS = {
    "whitespace": r"\S+",
    "word": r"[\p{L}\p{N}]+",
    "wordpunct": r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]",
    "char": r"\S",
}
LOWERCASE = {"word"}

_USER: dict[str, Callable[[Column], Column]] = {}


def register_tokenizer(name: str, fn: Callable[[Column], Column]) -> None:
    """Register a Column -> ARRAY<STRING> function under ``name``."""
    _USER[name] = fn


def tokens(x: Column, tokenizer: str = "wordpunct", lowercase: bool | None = None) -> Column:
    if tokenizer in _USER:
        out = _USER[tokenizer](x)
        return out
    if tokenizer not in PATTERNS:
        raise ValueError(f"unknown tokenizer {tokenizer!r}")
    low = tokenizer in LOWERCASE if lowercase is None else lowercase
    src = F.lower(x) if low else x
    return F.regexp_extract_all(src, F.lit(PATTERNS[tokenizer]), F.lit(0))


def tokenizer_udf(fn: Callable[[str], list[str]], name: str | None = None):
    """Wrap a per-text Python tokenizer as an Arrow UDF.

    ``fn`` is applied inside the Python worker to each text of an Arrow
    batch (a segmenter, a subword model...); the token lists of one piece
    of the batch are held at a time.  When ``name`` is given the
    tokenizer is also registered for every operator that takes a
    ``tokenizer=`` argument.
    """
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def _tok(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in pieces(batch):
                yield pa.array([None if t is None else list(fn(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    if name:
        register_tokenizer(name, lambda c: _tok(c))
    return _tok
