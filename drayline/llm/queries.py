"""The registered queries of this subpackage and their SQL twins."""

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


def load_all() -> None:
    from drayline.llm import (  # noqa: F401
        query_alignment,
        query_chat,
        query_decontamination,
        query_hamming_search,
        query_mixing,
        query_quality_rules,
        query_segmentation,
        query_quality_classifier,
        query_runs,
        query_separators,
        query_simhash,
        query_token_files,
        query_warc,
    )
