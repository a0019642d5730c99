"""Registry of the named queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Column
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its equal in SQL over the given tables where there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            from pagescale.plans.oracles import with_views

            ORACLES[name] = with_views(sql)
        return fn

    return register


def r6(col: Column | str, places: int = 6) -> Column:
    """Six places; the shift keeps exact ties from rounding either way."""
    return F.round((F.col(col) if isinstance(col, str) else col) + 1e-9, places)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Round the named double columns, or all of them."""
    names = names or tuple(f.name for f in df.schema.fields if f.dataType.simpleString() == "double")
    return df.withColumns({n: r6(n) for n in names})
