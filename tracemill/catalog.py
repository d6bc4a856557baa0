"""The registered queries: each operator over the driver's tables, or over small samples of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import champion_queries, corpus_queries, event_queries, game_queries, identity_queries, log_queries, output_queries, release_queries, role_queries, table_queries

_MODULES = (corpus_queries, event_queries, table_queries, game_queries, log_queries, output_queries, release_queries, role_queries, identity_queries, champion_queries, output_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of distinct documents, its runs counted, encoded with what they save, and packed."""
    return corpus_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in _MODULES for n, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for m in _MODULES for n, q in m.ORACLES.items()}
