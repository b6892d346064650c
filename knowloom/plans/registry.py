"""The registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` states the same result independently."""
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def load() -> None:
    """Import every catalog so that its queries register."""
    from . import catalog_code, catalog_graph, catalog_health, catalog_search, catalog_text, catalog_upkeep, catalog_verify  # noqa: F401
