"""Catalog tables: tables, columns, keys, edges and counts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.plans.dialects import sql_type

LEVELS = ("names", "columns", "full")
CATALOG_SCHEMA = (
    "table_name string, ordinal int, column_name string, data_type string, is_nullable boolean, "
    "is_pk boolean, pk_position int, is_user_defined boolean, column_default string"
)


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same DataFrame with its key recorded in the schema."""
    for position, key in enumerate(keys, start=1):
        metadata = {**df.schema[key].metadata, "pk_position": position}
        df = df.withMetadata(key, metadata)
    return df


def column_rows(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> list[tuple]:
    rows = []
    for name, df in tables.items():
        key = list(keys.get(name, ()))
        for i, f in enumerate(df.schema.fields, start=1):
            position = key.index(f.name) + 1 if f.name in key else f.metadata.get("pk_position")
            rows.append(
                (
                    name, i, f.name, f.metadata.get("sql_type") or sql_type(f.dataType), f.nullable,
                    position is not None, position, bool(f.metadata.get("user_defined")),
                    f.metadata.get("default"),
                )
            )
    return rows


def describe(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]] | None = None,
    level: str = "full",
) -> DataFrame:
    """Catalog of the given tables.

    ``names`` has one row per table, ``columns`` one per column; ``full`` adds
    the exact row count and the NULLs of each column, from one aggregation
    per table.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    if level == "names":
        return spark.createDataFrame(sorted((n,) for n in tables), "table_name string")
    columns = spark.createDataFrame(column_rows(tables, keys or {}), CATALOG_SCHEMA)
    if level == "columns":
        return columns
    return columns.join(null_counts(tables), ["table_name", "column_name"], "left")


def null_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and NULLs per column, one pass per table."""
    return reduce(DataFrame.unionAll, [_profile(name, df) for name, df in tables.items()])


def _profile(name: str, df: DataFrame) -> DataFrame:
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("present"))
            for i, c in enumerate(df.columns)
        ]
    )
    return counts.select(F.lit(name).alias("table_name"), "row_count", F.inline(entries)).select(
        "table_name", "column_name", "row_count", (F.col("row_count") - F.col("present")).alias("null_count")
    )


def null_violations(tables: Mapping[str, DataFrame], not_null: Mapping[str, Sequence[str]]) -> DataFrame:
    """NULLs in columns that must not have any."""
    checked = {
        name: df.select(*[f"`{c}`" for c in not_null[name]])
        for name, df in tables.items()
        if not_null.get(name)
    }
    return null_counts(checked).where(F.col("null_count") > 0)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact rows per table in one job (D6). Parquet answers from its footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def approximate_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Rows per table of Parquet files, by their footers alone (D7): table_name, estimated_rows.

    For information; nothing decides by it. The counts are pushed down to the file source, which needs other
    settings than row scans do: they hold in a session of their own. One row per table comes back.
    """
    frames = footer_counts(spark, paths)
    found = reduce(DataFrame.unionAll, frames).collect() if frames else []
    return spark.createDataFrame([tuple(r) for r in found], "table_name string, estimated_rows long")


def footer_counts(spark: SparkSession, paths: Mapping[str, str]) -> list[DataFrame]:
    """One plan per table that counts by footers."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return [
        session.read.parquet(path).agg(F.count(F.lit(1)).alias("estimated_rows")).select(F.lit(name).alias("table_name"), "estimated_rows")
        for name, path in paths.items()
    ]


def primary_keys(catalog: DataFrame) -> DataFrame:
    """Key columns of each table in key order."""
    return (
        catalog.where("is_pk")
        .groupBy("table_name")
        .agg(F.array_sort(F.collect_list(F.struct("pk_position", "column_name"))).alias("_k"))
        .select("table_name", F.col("_k.column_name").alias("key_columns"))
    )


def foreign_key_edges(references: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Distinct child and parent tables, without references to itself."""
    return (
        references.select(F.col(child).alias("child"), F.col(parent).alias("parent"))
        .where(F.col("child") != F.col("parent"))
        .distinct()
    )


def tables_without_key(catalog: DataFrame) -> DataFrame:
    """Tables none of whose columns is a key column (V3)."""
    return (
        catalog.groupBy("table_name")
        .agg(F.coalesce(F.max("is_pk"), F.lit(False)).alias("has_pk"))
        .where(~F.col("has_pk"))
        .select("table_name")
    )


def total_rows(counts: DataFrame, selected: Sequence[str] = ()) -> DataFrame:
    """Rows over all selected tables (V7)."""
    if selected:
        counts = counts.where(F.col("table_name").isin(list(selected)))
    return counts.agg(
        F.count("*").alias("tables"),
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("total_rows"),
    )


def spark_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Tables of the session's catalog by qualified name."""
    found = spark.catalog.listTables(database)
    return {
        f"{t.namespace[0]}.{t.name}" if t.namespace else t.name: spark.table(
            f"`{t.namespace[0]}`.`{t.name}`" if t.namespace else t.name
        )
        for t in sorted(found, key=lambda t: t.name)
        if not t.isTemporary and t.tableType != "VIEW"
    }


def materialize_view(spark: SparkSession, view: str, target: str) -> DataFrame:
    """Write the rows of a view as a table of its own."""
    spark.table(view).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def resolve_types(columns: DataFrame) -> DataFrame:
    """Resolve array and user-defined types of a remote column listing (D3).

    A type listed as ARRAY becomes ``element[]`` from ``udt_name`` (whose
    names start with an underscore); USER-DEFINED takes the name of the type
    and is flagged.
    """
    kind = F.upper("data_type")
    element = F.regexp_replace("udt_name", "^_", "")
    return columns.select(
        *[c for c in columns.columns if c not in ("data_type", "is_user_defined", "udt_name")],
        F.when(kind == "ARRAY", F.concat(element, F.lit("[]")))
        .when(kind == "USER-DEFINED", F.col("udt_name"))
        .otherwise(F.col("data_type"))
        .alias("data_type"),
        (kind == "USER-DEFINED").alias("is_user_defined"),
    )


# A text or number literal, and any casts behind it.
_LITERAL = re.compile(
    r"\s*(?:'(?P<text>(?:[^']|'')*)'|(?P<plain>[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|true|false|null))"
    r"(?:\s*::\s*[^':]+)*\s*",
    re.IGNORECASE,
)


def default_of(text: str | None, user_defined: bool = False) -> str | None:
    """Literal default of a column, or None.

    Casts behind the literal are taken off, quotes around it removed; a cast
    sign inside quotes is text. What is not a literal (a sequence, a function)
    can't be filled in and gives None.
    """
    found = _LITERAL.fullmatch(text) if text else None
    if not found or (found["plain"] or "").lower() == "null":
        return None
    if found["text"] is not None:
        return found["text"].replace("''", "'")
    return found["plain"]
