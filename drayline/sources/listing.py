"""File listings, formats, table names and selection.

Any Hadoop file system address works: local folders, ``s3a://``, ``sftp://``
and so on, with the connector jar the cluster provides (S13, S14).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Format per file extension, and the name of a table whose
# file name leaves nothing.
FORMATS = {
    ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".tsv": "csv",
    ".xlsx": "xlsx", ".xls": "xlsx", ".parquet": "parquet",
}
UNNAMED_TABLE = "imported_file"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(file_name(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substr(name, F.lit(1), F.char_length(name) - F.char_length(extension(path)))


def detect_format(path: Column) -> Column:
    """Format of a file by its extension; NULL when it is not supported."""
    formats = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.element_at(formats, extension(path))


def table_name(path: Column) -> Column:
    """Table name of a file: its stem with other signs as underscores."""
    clean = F.regexp_replace(stem(path), r"[^\p{L}\p{N}_]", "_")
    clean = F.when(clean.rlike(r"^\p{Nd}"), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.when(clean == "", UNNAMED_TABLE).otherwise(clean)


def list_files(
    spark: SparkSession, path: str, file_format: str | None = None, recursive: bool = False
) -> DataFrame:
    """Supported files under a path: address, name, size, format and table.

    Only metadata is read; the content column is pruned. An explicit
    ``file_format`` overrides the extension.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).select("path", F.col("length").alias("size"), "modificationTime")
    found = detect_format(F.col("path"))
    return (
        files.select(
            "path",
            file_name(F.col("path")).alias("name"),
            "size",
            (F.lit(file_format) if file_format else found).alias("format"),
            table_name(F.col("path")).alias("table_name"),
        )
        .where(found.isNotNull())
    )


def select_names(rows: DataFrame, names: DataFrame | Iterable[str], column: str) -> DataFrame:
    """Rows whose table is selected; an empty list selects everything."""
    if isinstance(names, DataFrame):
        return rows.join(names.select(names[names.columns[0]].alias(column)), column, "left_semi")
    chosen = list(names)
    return rows.where(F.col(column).isin(chosen)) if chosen else rows


def schema_of(table: Column) -> Column:
    """Schema part of a table name: the text before the first dot."""
    return F.when(F.contains(table, F.lit(".")), F.substring_index(table, ".", 1)).otherwise("default")


def filter_schemas(rows: DataFrame, schemas: Iterable[str], column: str = "table_name") -> DataFrame:
    """Tables of the given schemas; none given keeps all."""
    chosen = list(schemas)
    return rows.where(schema_of(F.col(column)).isin(chosen)) if chosen else rows


def tables_by_schema(rows: DataFrame, column: str = "table_name") -> DataFrame:
    """Table names with their schema and the number of tables in it.

    One row per table rather than one array per schema, so a schema with very
    many tables stays spread over tasks.
    """
    named = rows.select(
        schema_of(F.col(column)).alias("table_schema"), F.col(column).alias("table_name")
    ).distinct()
    sizes = named.groupBy("table_schema").agg(F.count("*").alias("tables"))
    return named.join(sizes, "table_schema")


def paths_by_format(listing: DataFrame) -> dict[str, list[str]]:
    """Addresses per format. Only file names reach the driver."""
    routed: dict[str, list[str]] = {}
    for row in listing.select("format", "path").orderBy("path").toLocalIterator():
        routed.setdefault(row["format"], []).append(row["path"])
    return routed
