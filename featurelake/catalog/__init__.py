"""Registered queries: one function and, where SQL can say it, one oracle per key."""

from __future__ import annotations

from importlib import import_module

AREAS = ["preparation", "stores", "monitoring", "models", "runlog", "streams"]


def load() -> tuple[dict, dict]:
    """All queries and oracles by key; a key registered twice is an error."""
    queries, oracles = {}, {}
    for area in AREAS:
        part = import_module(f"featurelake.catalog.{area}").catalog
        twice = queries.keys() & part.queries.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        queries.update(part.queries)
        oracles.update(part.oracles)
    return queries, oracles
