"""The library's own queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import with_tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its comparison SQL over the library's tables."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = with_tables(sql)
        return f

    return add


def sql_of(name: str) -> str:
    """The comparison SQL of a query registered before."""
    return _SQL[name]


def _load() -> None:
    from . import corpus_queries, discovery_queries, graph_queries, note_queries, source_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
