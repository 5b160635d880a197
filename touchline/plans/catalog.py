"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` per
operator key, each paired (where SQL can express it) with DuckDB oracle SQL.

Every query reads the driver tables (through ``contests``/``contest_odds``)
in full; parameters such as as-of dates or season splits are the operator's
feature, not sampling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries (idempotent)."""
    from . import queries_core, queries_features  # noqa: F401
    for mod in ("queries_models", "queries_star", "queries_sources", "queries_ml", "queries_store", "queries_rules", "queries_wide"):
        __import__(f"{__package__}.{mod}")
