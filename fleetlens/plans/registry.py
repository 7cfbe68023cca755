"""Registry of the catalogue queries: one Spark plan per operator, each
bound to the fixture tables, with the equivalent DuckDB SQL as its
oracle where one exists.

Binding modules register with ``@query(name, sql=...)``; the entry
module reads ``queries()`` and ``oracle_sql()``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}
_OPERATOR: dict[str, str] = {}

BINDING_MODULES = (
    "fleetlens.plans.fleet_bindings",
    "fleetlens.plans.membership_bindings",
    "fleetlens.plans.rules_bindings",
    "fleetlens.plans.column_bindings",
    "fleetlens.plans.history_bindings",
    "fleetlens.plans.io_bindings",
    "fleetlens.plans.stream_bindings",
)


def query(name: str, operator: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        _OPERATOR[name] = operator
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn
    return deco


def _load() -> None:
    for mod in BINDING_MODULES:
        importlib.import_module(mod)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def operators() -> dict[str, str]:
    _load()
    return dict(_OPERATOR)
