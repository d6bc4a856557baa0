"""Queries with their SQL, collected by module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def registry() -> tuple[dict[str, Callable[..., DataFrame]], dict[str, str], Callable]:
    """(queries, oracles, decorator): the decorator registers a query under its function's name."""
    queries: dict[str, Callable[..., DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
