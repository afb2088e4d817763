"""A set of named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def as_sql_rounds(c: Column, n: int) -> Column:
    """Rounded as DuckDB does, half away from zero after the multiplication by ten to the ``n``: of digits that end in 5 both take the same side."""
    return F.round(c * 10.0**n) / 10.0**n


class Plans:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is there already")
        self.queries[name] = query
        if sql:
            self.sql[name] = sql
