"""The queries by name, each with its SQL for DuckDB where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NUDGE = 1e-11


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, never negative zero, exact halves always up: so that other engines' sums compare."""
    return df.select(*[(F.round(F.col(f"`{c}`") + NUDGE, places) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def sql_rounded(inner: str, doubles: str, rest: str = "", places: int = 6) -> str:
    """SELECT of an inner query's columns, the named doubles rounded likewise."""
    cols = [*rest.split(), *[f"round({c} + {NUDGE!r}, {places}) + 0.0 AS {c}" for c in doubles.split()]]
    at = max(0, inner.rfind("\nSELECT "))
    return f"{inner[:at]}\nSELECT {', '.join(cols)} FROM ({inner[at:].strip()}) AS q_"
