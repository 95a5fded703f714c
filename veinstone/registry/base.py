"""Registered queries: a Spark callable and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    covers: str = ""


class Group:
    """Collects the queries of one module in order of definition."""

    def __init__(self) -> None:
        self.queries: list[Query] = []

    def add(self, sql: str | None = None, covers: str = ""):
        def keep(run):
            self.queries.append(Query(run.__name__, run, sql, covers))
            return run

        return keep
