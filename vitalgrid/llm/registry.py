"""The queries of this package and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    importlib.import_module("vitalgrid.llm.queries")
    pipeline = importlib.import_module("corpus_pipeline")
    QUERIES["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL:
        SQL["pipeline"] = pipeline.ORACLE_SQL
    return QUERIES, SQL
