"""All registered queries of the detection and track engine, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query function under name; sql is the DuckDB statement with the same rows."""

    def wrap(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return wrap


def _load() -> None:
    """Import the modules that register queries; not before they are asked for, as executors import some of them alone."""
    from tessel.plans import datasets, detection, evaluation, geometry, merging, more, motion, results, tracks  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
