"""Queries of the engine: name -> (query, independent SQL or None)."""

from __future__ import annotations

from weftline.queries import audit, docs, flow, graph, modules, reading, scalars, wire  # noqa: F401  (they register themselves)
from weftline.queries.registry import CATALOG, Query


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
