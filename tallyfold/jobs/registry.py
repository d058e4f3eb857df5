"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, so that sums in another order give the same. The small shift keeps exact halves off the border; it leaves no negative zero."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(1.3 * 10.0 ** -(digits + 2)), digits) + F.lit(0.0)


def rs(expression: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"round({expression} + 1.3e-{digits + 2}, {digits}) + 0.0"
