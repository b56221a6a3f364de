"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: The time at which queries run, as SQL.
NOW = "TIMESTAMP '2024-01-15 12:00:00'"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name, with its SQL if there is one."""

        def add(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.sql[query.__name__] = sql
            return query

        return add


def stamp(c: Column | str) -> Column:
    """A timestamp as text, which compares alike everywhere."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def eastern(c: str) -> str:
    return f"({c} AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
