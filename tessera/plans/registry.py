"""All registered queries with their SQL for a second engine.

A query is registered by a decorator where it is defined; importing the query modules fills the two tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    from tessera.plans import estimation_queries, format_queries, general_queries, interval_queries, sequence_queries, statistic_queries, stream_queries, tree_queries  # noqa: F401
