"""All registered queries: name -> (Spark query, DuckDB text or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "html_queries",
    "json_queries",
    "gate_queries",
    "frontier_queries",
    "view_queries",
    "run_queries",
    "catalog_queries",
    "stream_queries",
    "collect_queries",
)


def registry() -> dict:
    found = {}
    for name in MODULES:
        module = import_module(f"{__package__}.{name}")
        found.update(module.QUERIES)
    return found
