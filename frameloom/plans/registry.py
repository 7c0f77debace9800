"""Query registry: name -> Spark callable, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def wrap(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return wrap

    def merge(self, other: Registry) -> None:
        clash = self.queries.keys() & other.queries.keys()
        if clash:
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        self.queries |= other.queries
        self.sql |= other.sql
