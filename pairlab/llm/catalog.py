"""All operator queries (importing this module fills the registry)."""

from pairlab.llm import (  # noqa: F401
    chat_windows,
    collocations,
    decontaminate,
    edit_line_dedup,
    mixing,
    parity_join,
    parse_dedup,
    periodic_runs,
    pii_boost,
    repetition_quality,
    secret_parts,
    simhash_tiles,
    url_filter,
)
from pairlab.llm.registry import ORACLE, QUERIES  # noqa: F401
