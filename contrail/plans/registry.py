"""The registered queries: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(column: Column | str, digits: int = 4) -> Column:
    """Rounding that both engines compute alike, also where sums in another order end on either side of a tie."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.floor(c * 10.0**digits + 0.5001).cast("double") / 10.0**digits


def R(sql: str, digits: int = 4) -> str:
    """The same in SQL."""
    return f"(floor(({sql})::DOUBLE * 1e{digits} + 0.5001)::DOUBLE / 1e{digits})"


def us(column: Column | str) -> Column:
    return F.unix_micros(column)


def load_all() -> None:
    """Import the modules that register queries."""
    from contrail.plans import (  # noqa: F401
        queries_alerts,
        queries_evaluation,
        queries_joins,
        queries_signals,
        queries_sources,
        queries_statistics,
        queries_streaming,
        queries_text,
        queries_tracks,
    )
