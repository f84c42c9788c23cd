"""The registered queries: for each name a Spark function and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
SECTIONS = (
    "intake",
    "quality",
    "dedup",
    "sampling",
    "audit",
    "evaluation",
    "runs",
    "evidence",
    "streams",
    "bundle",
)


class Registry:
    """Collects the queries of one section."""

    def __init__(self) -> None:
        self.functions: dict[str, QueryFn] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def add(fn: QueryFn) -> QueryFn:
            if name in self.functions:
                raise ValueError(f"query {name} is registered twice")
            self.functions[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add


def _sections() -> list[Registry]:
    return [import_module(f"itemlab.queries.{name}").registry for name in SECTIONS]


def all_queries() -> dict[str, QueryFn]:
    return {name: fn for section in _sections() for name, fn in section.functions.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for section in _sections() for name, sql in section.sql.items()}
