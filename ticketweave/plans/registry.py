"""Registration of queries together with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if SQL can state its result, that SQL."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", *columns)


def load_all() -> None:
    """Import the modules whose queries register themselves."""
    from . import index_queries, table_queries, text_queries  # noqa: F401
