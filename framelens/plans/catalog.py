"""Registry of the named queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where plain SQL can express it, the statement that checks it."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return add


def r6(column: Column | str) -> Column:
    """Six decimals, without negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6) + F.lit(0.0)


def q6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"
