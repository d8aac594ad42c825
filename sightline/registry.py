"""All registered queries of the engine, each with DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name. covers: the operators it shows."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def load() -> None:
    """Imports the modules that register queries."""
    from sightline.plans import aggregates, candidates, chains, expressions, filters, graphs, metrics, query_text, relational, scalars, scoring, sources, streams, vectors, windows  # noqa: F401


load()
