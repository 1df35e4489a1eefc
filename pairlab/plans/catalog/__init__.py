"""All registered queries (importing this package fills the registry)."""

from pairlab.plans.catalog import (  # noqa: F401
    base,
    corpus,
    examples,
    flagship,
    generate,
    io,
    judge,
    logs,
    metrics,
    profile,
    prompts,
    text,
)
from pairlab.plans.catalog.base import ORACLE, REGISTRY  # noqa: F401
