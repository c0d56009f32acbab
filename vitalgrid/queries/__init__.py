"""Registered queries: one per operator, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = [
    "ingest", "tables", "windows", "joins", "decisions", "learning", "network", "streams",
]


def load():
    """Import all query modules and return (queries, sql)."""
    from vitalgrid.queries import base

    for m in MODULES:
        importlib.import_module(f"vitalgrid.queries.{m}")
    return base.QUERIES, base.SQL
