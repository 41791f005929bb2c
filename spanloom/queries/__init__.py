"""Registered queries: every operator run over the driver's tables, with oracle SQL where SQL
can state it. Each module fills a `Registry`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(function: Query) -> Query:
            self.queries[name] = function
            if sql is not None:
                self.oracle[name] = sql
            return function

        return keep
