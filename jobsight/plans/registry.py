"""Registry of named queries: each is ``fn(spark, data_dir) -> DataFrame`` plus an
optional DuckDB oracle SQL text over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, note: str = ""):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, note)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # importing the modules fills the registry
    from . import q_functions, q_read, q_write, q_graph, q_stream  # noqa: F401
    return QUERIES
