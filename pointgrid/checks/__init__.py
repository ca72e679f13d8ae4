"""Every operator as a query over the given tables, with the SQL that must agree.

``QUERIES`` maps a key to ``fn(views) -> DataFrame``; ``SQL`` maps the key to the
equivalent statement. Operators without a relational form have no SQL entry.
"""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}


def check(key: str, sql: str | None = None):
    """Register ``fn`` under ``key`` together with its reference SQL."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


def load_all() -> None:
    for name in ("filters", "scalars", "stats", "voxels", "grids", "files", "neighbors", "placement", "graph", "panorama", "redaction", "merging", "doors"):
        importlib.import_module(f"{__name__}.{name}")
