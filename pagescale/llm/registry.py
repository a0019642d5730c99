"""Named queries of this package and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def all_queries() -> dict[str, Query]:
    importlib.import_module("pagescale.llm.queries")
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    importlib.import_module("pagescale.llm.queries")
    return dict(ORACLES)
