"""Named queries over the test tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from modlens.registry import (
    analysis, cleaning, features, identity, metrics, models, negation, profile, tables, tfidf,
    vectors,
)
from modlens.registry.inputs import Query

MODULES = (
    cleaning, identity, negation, features, tfidf, profile, metrics, analysis, vectors, models, tables,
)


def all_queries() -> dict[str, Query]:
    """Every query by name."""
    out: dict[str, Query] = {}
    for module in MODULES:
        for name, query in module.QUERIES.items():
            if name in out:
                raise ValueError(f"two queries are named {name}")
            out[name] = query
    return out
