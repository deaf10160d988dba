"""Registry of named queries: each has a Spark builder and (when the operator
is SQL-expressible) an equivalent DuckDB SQL text for the oracle check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


REGISTRY: dict[str, Query] = {}


def register(name: str, ids: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ids)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from tillcycle.plans import (  # noqa: F401
        queries_core, queries_cycle, queries_entries, queries_evals, queries_forecast,
        queries_report, queries_stores, queries_text)
    return REGISTRY
