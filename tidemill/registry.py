"""Register of queries: a name, a function of (spark, folder), and SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_MODULES = [
    "tidemill.plans.tpch",
    "tidemill.plans.star",
    "tidemill.plans.sql",
    "tidemill.operators.relational",
    "tidemill.operators.aggregates",
    "tidemill.operators.frames",
    "tidemill.functions.scalar",
    "tidemill.sources.queries",
    "tidemill.streaming.queries",
    "tidemill.versioned.queries",
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator that registers a query under ``name``."""

    def add(f: Query) -> Query:
        register(name, f, sql)
        return f

    return add


def register(name: str, f: Query, sql: str | None = None) -> None:
    if name in _queries:
        raise ValueError(f"two queries are called {name}")
    _queries[name] = f
    if sql:
        _sql[name] = sql


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(module)


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _sql
