"""CSV, TSV, JSON, JSON Lines and Parquet files.

All readers split large files over tasks where the format allows it and keep
text as text; types are inferred and applied afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.operators.inference import (
    decode_bits,
    infer_record_keys,
    infer_types,
    inferred_types,
    rank_bits,
    text_rank,
)
from drayline.operators.mapping import Mapped, cast_columns
from drayline.plans.dialects import POSTGRESQL
from drayline.sources.blocks import csv_records, json_elements, opens_cell
from drayline.sources.listing import extension

Paths = str | Sequence[str]
FILE_SCHEMA = (
    "path string, ordinal int, column_name string, data_type string, is_nullable boolean"
)


def _as_list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


# ---------------------------------------------------------------------------
# Delimited text
# ---------------------------------------------------------------------------


def csv_traits(spark: SparkSession, paths: Paths, separator: str | None = None) -> DataFrame:
    """Per file: is it UTF-8, does a quoted cell span lines (one of the header), and its header's hash.

    A line scan: the text source keeps raw bytes, so all is checked line by
    line in parallel, and a file is never held as one value. As long as no
    line opens a cell that it doesn't close, none starts inside one.
    """
    path = F.col("_metadata.file_path")
    tabs = opens_cell(F.col("value"), separator or "\t")
    opens = tabs if separator else F.when(extension(path) == ".tsv", tabs).otherwise(opens_cell(F.col("value"), ","))
    lines = spark.read.text(_as_list(paths)).select(
        path.alias("path"),
        # Only lines of a file's first block can be its header.
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("line"),
        F.expr("is_valid_utf8(value)").alias("utf8"),
        opens.alias("opens"),
        "value",
    )
    return lines.groupBy("path").agg(
        F.every("utf8").alias("is_utf8"),
        F.some("opens").alias("spans_lines"),
        F.min_by("opens", "line").alias("header_spans_lines"),
        F.first(extension(F.col("path"))).alias("extension"),
        F.md5(F.min_by("value", "line")).alias("header"),
    )


# Hold the first filled cell beyond the header of a row, and the row as it was read.
SURPLUS = "_surplus_cell"
RECORD = "_record"


def read_csv(
    spark: SparkSession,
    paths: Paths,
    separator: str | None = None,
    check_files: bool = True,
) -> DataFrame:
    """Delimited files with a header row, all cells as text.

    Rows with a filled cell beyond the header are left out; ``csv_surplus`` has them.

    ``.tsv`` files are split at tabs, others at commas, unless a separator is
    given. Files that are not valid UTF-8 are read as Latin-1. All files are
    split; where cells span lines, records are cut by ``csv_records``. Files
    may have different headers; a column a file lacks is NULL, and so are
    missing and empty cells. ``check_files=False`` skips the line scan for
    UTF-8 files of one header without such cells.
    """
    return csv_rows(spark, paths, separator, check_files).where(F.col(SURPLUS).isNull()).drop(SURPLUS, RECORD)


def csv_surplus(
    spark: SparkSession, paths: Paths, separator: str | None = None, check_files: bool = True
) -> DataFrame:
    """Rows of delimited files with a filled cell beyond the header: the first one as ``SURPLUS``, all as ``RECORD``."""
    return csv_rows(spark, paths, separator, check_files).where(F.col(SURPLUS).isNotNull())


def csv_rows(
    spark: SparkSession, paths: Paths, separator: str | None = None, check_files: bool = True
) -> DataFrame:
    """All rows of delimited files, with ``SURPLUS`` and ``RECORD``."""
    if not check_files:
        tabs = all(p.lower().endswith(".tsv") for p in _as_list(paths))
        sep = separator or ("\t" if tabs else ",")
        return _with_surplus(spark, (sep, True, False), _as_list(paths))
    groups: dict[tuple, list[str]] = {}
    for row in csv_traits(spark, paths, separator).orderBy("path").toLocalIterator():
        sep = separator or ("\t" if row.extension == ".tsv" else ",")
        header = row.path if row.header_spans_lines else row.header
        kind = (sep, row.is_utf8, row.spans_lines, header)
        groups.setdefault(kind, []).append(plain_path(row.path))
    if not groups:
        return _with_surplus(spark, (separator or ",", True, False), _as_list(paths))
    # Fewest readers: one per kind of file.
    frames = [_with_surplus(spark, kind[:3], group) for kind, group in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _with_surplus(spark: SparkSession, kind: tuple[str, bool, bool], paths: list[str]) -> DataFrame:
    """Files of one header; the reader keeps the text of each row that has not as many cells as it."""
    named = _csv_reader(spark, *kind).csv(paths)
    text = T.StringType()
    if not named.columns:
        return named.withColumns({SURPLUS: F.lit(None).cast(text), RECORD: F.lit(None).cast(text)})
    schema = T.StructType([*named.schema.fields, T.StructField(RECORD, text)])
    if kind[2]:
        records = csv_records(spark, paths, kind[0], kind[1]).where(~F.col("first"))
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)
        options = {"sep": kind[0], "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD, "columnPruning": "false"}
        rows = records.select(F.from_csv("record", F.lit(ddl), options).alias("_row")).select("_row.*")
        return _surplus_marked(rows, named.columns, kind[0])
    reader = _csv_reader(spark, *kind).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD)
    # Rows are held against all columns, whichever a query takes. The header was just read: its check would
    # miss the added column.
    rows = reader.option("columnPruning", False).option("enforceSchema", True).schema(schema).csv(paths)
    return _surplus_marked(rows, named.columns, kind[0])


def _surplus_marked(rows: DataFrame, names: list[str], separator: str) -> DataFrame:
    record = F.rtrim(F.col(RECORD), F.lit("\r\n"))
    beyond = F.slice(_split_record(record, separator), len(names) + 1, 1 << 30)
    filled = F.get(F.filter(beyond, lambda c: c != ""), F.lit(0))
    # The reader refuses plans that need no other column than the record.
    other = F.coalesce(F.octet_length(F.col(f"`{names[0]}`")), F.lit(0)) >= 0
    return rows.withColumn(SURPLUS, F.when(F.col(RECORD).isNotNull() & other, filled)).withColumn(RECORD, record)


def plain_path(path: str) -> str:
    # File addresses come back percent-encoded; the reader takes plain names,
    # in which pattern signs need a backslash.
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))


def _csv_reader(spark: SparkSession, separator: str, utf8: bool, spans_lines: bool):
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8" if utf8 else "ISO-8859-1")
        .option("multiLine", spans_lines)
        .option("enforceSchema", False)
    )


def infer_csv_files(spark: SparkSession, paths: Paths, separator: str = ",", lattice: str = "ordered") -> DataFrame:
    """Schema of each file of many, in passes over all of them at once.

    A line scan finds every file's header and whether cells span lines; then
    all cells are ranked by place and grouped by file. Files may have
    different headers and are UTF-8; the records of those with cells that
    span lines are cut by ``csv_records``. Only the names of these reach the driver.
    """
    lines = spark.read.text(_as_list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("line"),
        "value",
        opens_cell(F.col("value"), separator).alias("opens"),
    )
    found = lines.groupBy("path").agg(F.min_by("value", "line").alias("header"), F.some("opens").alias("spans"))
    found = found.persist()
    try:
        spanning = [plain_path(r.path) for r in found.where("spans").select("path").toLocalIterator()]
        headers = found.where(~F.col("spans")).select("path", "header")
        if spanning:
            records = csv_records(spark, spanning, separator, True)
            headers = headers.unionByName(records.where("first").select("path", F.col("record").alias("header")))
        headers = headers.select("path", _split_header(F.col("header"), separator).alias("names"))
        width = headers.agg(F.max(F.size("names"))).first()[0] or 0
        plain = [plain_path(r.path) for r in found.where(~F.col("spans")).select("path").toLocalIterator()] if spanning else _as_list(paths)
    finally:
        found.unpersist()
    if not width:
        return spark.createDataFrame([], FILE_SCHEMA)

    # With a schema given, the reader drops each file's first line unread.
    places = [f"c{i}" for i in range(width)]
    cells = []
    if plain:
        reader = spark.read.schema(", ".join(f"{c} string" for c in places)).option("sep", separator)
        rows = reader.option("escape", '"').option("header", True).csv(plain)
        cells.append(rows.select(F.col("_metadata.file_path").alias("path"), *places))
    if spanning:
        split = records.where(~F.col("first")).select("path", _split_record(F.col("record"), separator).alias("cells"))
        cells.append(split.select("path", *[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(places)]))
    data = reduce(DataFrame.unionByName, cells)
    ranks = data.select("path", *[text_rank(F.col(c)).alias(c) for c in places])
    bits = ranks.groupBy("path").agg(*[rank_bits(F.col(c)).alias(c) for c in places])
    return (
        headers.join(bits, "path", "left")
        .select("path", F.posexplode("names").alias("ordinal", "column_name"), F.array(*places).alias("bits"))
        .withColumn("bits", F.coalesce(F.get("bits", F.col("ordinal")), F.lit(0)))
        .select(
            "path",
            "ordinal",
            "column_name",
            decode_bits(F.col("bits"), lattice).alias("data_type"),
            (F.col("bits").bitwiseAND(F.lit(1)) == 1).alias("is_nullable"),
        )
    )


def _split_header(header: Column, separator: str) -> Column:
    """Cells of a header line, with quotes taken off."""
    sep = re.escape(separator)
    cells = F.regexp_extract_all(header, F.lit(f'(?:^|{sep})("(?:[^"]|"")*"|[^{sep}]*)'), F.lit(1))
    return F.transform(
        cells,
        lambda c: F.when(
            F.startswith(c, F.lit('"')),
            F.replace(F.substr(c, F.lit(2), F.char_length(c) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(c),
    )


def _split_record(record: Column, separator: str) -> Column:
    """Cells of a row, which may span lines, with quotes taken off."""
    sep = re.escape(separator)
    pattern = f'{sep}("(?:[^"]++|"")*+"(?=$|{sep})|(?:(?!{sep})[\\s\\S])*+)'
    cells = F.regexp_extract_all(F.concat(F.lit(separator), record), F.lit(pattern), F.lit(1))
    return F.transform(
        cells,
        lambda c: F.when(
            F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.char_length(c) > 1),
            F.replace(F.substr(c, F.lit(2), F.char_length(c) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(c),
    )


# ---------------------------------------------------------------------------
# JSON
# ---------------------------------------------------------------------------


def json_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """Every line of JSON Lines files: its text, place, and whether it is an object.

    Columns: path, block, line (their order is the order in the file), record
    and is_record. Blank lines are left out.
    """
    lines = spark.read.text(_as_list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").alias("record"),
    )
    parsed = F.try_parse_json("record")
    kind = F.schema_of_variant(parsed)
    return lines.where(F.trim("record") != "").withColumn(
        "is_record", F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))
    )


def json_records(spark: SparkSession, paths: Paths) -> DataFrame:
    """Objects of JSON documents, one row per object, as text.

    A document is an array of objects, whose other elements are skipped, or a
    single object. A document that is neither, or an object that is broken,
    raises. Documents are read in blocks by many tasks.
    """
    records = json_elements(spark, _as_list(paths))
    kind = F.schema_of_variant(F.parse_json("record"))
    return records.where(F.startswith(kind, F.lit("OBJECT"))).select("path", "block", "line", "record")


def pick_keys(records: DataFrame, keys: Sequence[str], record: str = "record") -> DataFrame:
    """Keys of JSON records as text columns; nested values as JSON text.

    A value that is missing or null is NULL, so one odd value costs a cell
    and never the row.
    """
    parsed = records.withColumn("_v", F.parse_json(record))

    def found(key: str) -> Column:
        # A path has no escapes; a key with both kinds of quotes has no path.
        if '"' not in key:
            return F.try_variant_get("_v", f'$["{key}"]', "variant")
        if "'" not in key:
            return F.try_variant_get("_v", f"$['{key}']", "variant")
        return F.try_element_at(F.col("_v").cast("map<string,variant>"), F.lit(key))

    def cell(key: str) -> Column:
        value = found(key)
        text = F.try_variant_get(value, "$", "string")
        return F.when(~F.is_variant_null(value), text).alias(key)

    return parsed.select(*[cell(k) for k in keys])


def read_jsonl(
    spark: SparkSession, paths: Paths, keys: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON Lines files as text columns, and the lines left out.

    Blank, broken and non-object lines are skipped; the second DataFrame holds
    them with their place. Without ``keys`` one pass finds them.
    """
    lines = json_lines(spark, paths)
    records = lines.where("is_record")
    if keys is None:
        keys = _record_keys(records)
    return pick_keys(records, keys), lines.where(~F.col("is_record")).drop("is_record")


def read_json(spark: SparkSession, paths: Paths, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of JSON documents as text columns."""
    records = json_records(spark, paths)
    return pick_keys(records, keys if keys is not None else _record_keys(records))


def _record_keys(records: DataFrame) -> list[str]:
    order = ["path", "block", "line"]
    found = infer_record_keys(records, position=order)
    return [r.column_name for r in found.orderBy("first_seen").select("column_name").collect()]


# ---------------------------------------------------------------------------
# Parquet, and any format by name
# ---------------------------------------------------------------------------


def read_parquet(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.parquet(*_as_list(paths))


def read_files(spark: SparkSession, paths: Paths, file_format: str) -> DataFrame:
    """Rows of files of one format, in one plan over all of them."""
    if file_format == "csv":
        return read_csv(spark, paths)
    if file_format == "json":
        return read_json(spark, paths)
    if file_format == "jsonl":
        return read_jsonl(spark, paths)[0]
    if file_format == "parquet":
        return read_parquet(spark, paths)
    if file_format == "xlsx":
        from drayline.sources.workbooks import read_workbooks

        return read_workbooks(spark, paths)
    raise ValueError(f"unsupported format {file_format!r}")


def typed(df: DataFrame, lattice: str = "ordered", on_error: str = "reject") -> Mapped:
    """Infer the types of text columns and apply them.

    Two passes over the files: one to infer, one to cast. Cells that do not
    fit their column's type end in the rejects.
    """
    types = inferred_types(infer_types(df, lattice))
    return cast_columns(df, types, POSTGRESQL, on_error)
