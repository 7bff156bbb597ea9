"""The registered queries: every operator over the given tables.

A query takes ``(spark, sf_dir)``. Its SQL twin runs on the same Parquet
tables and has the same column names. Queries run over whole tables; where a
check needs damaged or rewritten input, Spark derives it from a given table,
so the work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL twin."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> None:
    from registry import checks, dates, rules, scans, streams, types, writes  # noqa: F401
