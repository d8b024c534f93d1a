"""Query registry: a name, a DataFrame builder and, where SQL can express it, the matching SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def bind(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return bind


def load_all() -> None:
    """Import the modules that register queries."""
    from . import (blocks, dithering, events, files, geometry, glitches, jobs, screening,  # noqa: F401
                   separation)
