"""Type translation between SQL dialects (T1, T3, T4) and to Spark types.

Every dialect's type names map to a shared kind, and every kind has one
spelling per target dialect; the rule table for all pairs is the product of
the two. A few pairs spell a kind differently and a few leave names without a
rule; both are listed.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTGRESQL, MYSQL, SNOWFLAKE, SQLITE, SQLSERVER = (
    "postgresql", "mysql", "snowflake", "sqlite", "sqlserver",
)
DIALECTS = (POSTGRESQL, MYSQL, SNOWFLAKE, SQLITE, SQLSERVER)

# ---------------------------------------------------------------------------
# Type names of each dialect and the kind each stands for.
# ---------------------------------------------------------------------------

KIND_OF = {
    POSTGRESQL: {
        "integer": "int32", "bigint": "int64", "smallint": "int16",
        "serial": "serial32", "bigserial": "serial64", "boolean": "boolean",
        "text": "text", "character varying": "varchar", "varchar": "varchar", "char": "char",
        "numeric": "decimal", "decimal": "decimal", "real": "float32", "double precision": "float64",
        "date": "date", "timestamp without time zone": "timestamp",
        "timestamp with time zone": "timestamptz", "timestamp": "timestamp",
        "time without time zone": "time", "time with time zone": "timetz",
        "json": "json", "jsonb": "json", "uuid": "uuid", "bytea": "bytes",
        "inet": "address", "cidr": "address", "macaddr": "hardware", "array": "array",
        "interval": "interval", "money": "money", "xml": "string",
        "point": "point", "polygon": "polygon",
    },
    MYSQL: {
        "int": "int32", "bigint": "int64", "smallint": "int16", "tinyint": "int16",
        "mediumint": "int32", "float": "float32", "double": "float64", "decimal": "decimal",
        "varchar": "varchar", "char": "char", "text": "text", "mediumtext": "text",
        "longtext": "text", "tinytext": "tinytext", "blob": "bytes", "mediumblob": "bytes",
        "longblob": "bytes", "tinyblob": "bytes", "date": "date", "datetime": "timestamp",
        "timestamp": "timestamp", "time": "time", "year": "int16", "json": "json",
        "enum": "choice", "set": "choice", "binary": "bytes", "varbinary": "bytes",
        "bit": "bits", "boolean": "boolean", "point": "point", "polygon": "polygon",
    },
    SNOWFLAKE: {
        "number": "decimal", "integer": "int32", "bigint": "int64", "smallint": "int16",
        "float": "approximate", "double": "float64", "varchar": "varchar", "char": "char",
        "text": "text", "string": "text", "boolean": "boolean", "date": "date",
        "timestamp_ntz": "timestamp", "timestamp_tz": "timestamptz",
        "timestamp_ltz": "timestamptz", "time": "time", "variant": "json", "object": "json",
        "array": "json", "binary": "bytes",
    },
    SQLITE: {
        "integer": "int32", "text": "string", "real": "approximate", "blob": "bytes",
        "numeric": "decimal",
    },
    SQLSERVER: {
        "int": "int32", "bigint": "int64", "smallint": "int16", "bit": "boolean",
        "nvarchar": "varchar", "varchar": "varchar", "nchar": "char", "char": "char",
        "text": "text", "ntext": "text", "real": "float32", "float": "float64",
        "decimal": "decimal", "numeric": "decimal", "date": "date", "datetime": "timestamp",
        "datetime2": "timestamp", "datetimeoffset": "timestamptz", "time": "time",
        "varbinary": "bytes",
    },
}

# ---------------------------------------------------------------------------
# Spelling of each kind per target dialect.
# ---------------------------------------------------------------------------

SPELLING = {
    POSTGRESQL: {
        "int16": "SMALLINT", "int32": "INTEGER", "int64": "BIGINT", "boolean": "BOOLEAN",
        "float32": "REAL", "float64": "DOUBLE PRECISION", "approximate": "DOUBLE PRECISION",
        "decimal": "NUMERIC", "varchar": "VARCHAR", "char": "CHAR", "text": "TEXT",
        "tinytext": "TEXT", "choice": "TEXT", "string": "TEXT", "bytes": "BYTEA",
        "date": "DATE", "timestamp": "TIMESTAMP", "timestamptz": "TIMESTAMPTZ", "time": "TIME",
        "json": "JSONB", "bits": "BIT", "point": "POINT", "polygon": "POLYGON",
    },
    MYSQL: {
        "int16": "SMALLINT", "int32": "INT", "int64": "BIGINT",
        "serial32": "INT AUTO_INCREMENT", "serial64": "BIGINT AUTO_INCREMENT",
        "boolean": "TINYINT(1)", "float32": "FLOAT", "float64": "DOUBLE", "approximate": "DOUBLE",
        "decimal": "DECIMAL(18,2)", "money": "DECIMAL(19,4)", "varchar": "VARCHAR(255)",
        "char": "CHAR(1)", "text": "TEXT", "string": "TEXT", "bytes": "BLOB",
        "date": "DATE", "timestamp": "DATETIME", "timestamptz": "DATETIME",
        "time": "TIME", "timetz": "TIME", "json": "JSON", "array": "JSON",
        "uuid": "CHAR(36)", "address": "VARCHAR(45)", "hardware": "VARCHAR(17)",
        "interval": "VARCHAR(50)", "point": "POINT", "polygon": "POLYGON",
    },
    SNOWFLAKE: {
        "int16": "SMALLINT", "int32": "INTEGER", "int64": "BIGINT",
        "serial32": "INTEGER AUTOINCREMENT", "serial64": "BIGINT AUTOINCREMENT",
        "boolean": "BOOLEAN", "float32": "FLOAT", "float64": "DOUBLE", "approximate": "FLOAT",
        "decimal": "NUMBER(18,2)", "money": "NUMBER(19,4)", "varchar": "VARCHAR", "char": "CHAR",
        "text": "TEXT", "tinytext": "TEXT", "choice": "VARCHAR", "string": "VARCHAR",
        "bytes": "BINARY", "date": "DATE", "timestamp": "TIMESTAMP_NTZ",
        "timestamptz": "TIMESTAMP_TZ", "time": "TIME", "timetz": "TIME",
        "json": "VARIANT", "array": "VARIANT", "uuid": "VARCHAR(36)",
        "address": "VARCHAR(45)", "interval": "VARCHAR(50)",
    },
    SQLITE: {
        "int16": "INTEGER", "int32": "INTEGER", "int64": "INTEGER", "serial32": "INTEGER",
        "serial64": "INTEGER", "boolean": "INTEGER", "float32": "REAL", "float64": "REAL",
        "approximate": "REAL", "decimal": "REAL", "money": "REAL", "varchar": "TEXT",
        "char": "TEXT", "text": "TEXT", "tinytext": "TEXT", "choice": "TEXT", "string": "TEXT",
        "bytes": "BLOB", "date": "TEXT", "timestamp": "TEXT", "timestamptz": "TEXT",
        "time": "TEXT", "timetz": "TEXT", "json": "TEXT", "array": "TEXT", "uuid": "TEXT",
        "address": "TEXT", "interval": "TEXT",
    },
    SQLSERVER: {
        "int16": "SMALLINT", "int32": "INT", "int64": "BIGINT", "serial32": "INT IDENTITY(1,1)",
        "serial64": "BIGINT IDENTITY(1,1)", "boolean": "BIT", "float32": "REAL",
        "float64": "FLOAT", "approximate": "REAL", "decimal": "DECIMAL(18,2)",
        "money": "DECIMAL(19,4)", "varchar": "NVARCHAR(255)", "char": "NCHAR(1)",
        "text": "NVARCHAR(MAX)", "tinytext": "NVARCHAR(255)", "choice": "NVARCHAR(255)",
        "string": "NVARCHAR(MAX)", "bytes": "VARBINARY(MAX)", "date": "DATE",
        "timestamp": "DATETIME2", "timestamptz": "DATETIMEOFFSET", "time": "TIME",
        "timetz": "DATETIMEOFFSET", "json": "NVARCHAR(MAX)", "array": "NVARCHAR(MAX)",
        "uuid": "CHAR(36)", "address": "NVARCHAR(45)", "interval": "NVARCHAR(50)",
    },
}

# Pairs that spell a kind differently.
PAIR_SPELLING = {
    (POSTGRESQL, SNOWFLAKE): {"char": "CHAR(1)"},
    (MYSQL, SNOWFLAKE): {"decimal": "NUMBER"},
    (SNOWFLAKE, MYSQL): {"decimal": "DECIMAL", "char": "CHAR"},
    (SQLITE, SQLSERVER): {"approximate": "FLOAT"},
}

# Names a pair has no rule for; they get the default string type.
_NO_GEOMETRY = ("point", "polygon")
_MYSQL_SPECIAL = ("year", "binary", "varbinary", "bit", *_NO_GEOMETRY)
PAIR_WITHOUT_RULE = {
    (POSTGRESQL, SNOWFLAKE): ("cidr", "macaddr", *_NO_GEOMETRY),
    (POSTGRESQL, SQLITE): ("cidr", "macaddr", *_NO_GEOMETRY),
    (POSTGRESQL, SQLSERVER): ("cidr", "macaddr", *_NO_GEOMETRY),
    (MYSQL, SNOWFLAKE): _MYSQL_SPECIAL,
    (MYSQL, SQLITE): _MYSQL_SPECIAL,
    (MYSQL, SQLSERVER): _MYSQL_SPECIAL,
}

# Default string type and array type per target.
DEFAULT_STRING = {
    POSTGRESQL: "TEXT", MYSQL: "VARCHAR(255)", SNOWFLAKE: "VARCHAR", SQLITE: "TEXT",
    SQLSERVER: "NVARCHAR(MAX)",
}
ARRAY_TYPE = {MYSQL: "JSON", SNOWFLAKE: "VARIANT", SQLITE: "TEXT", SQLSERVER: "NVARCHAR(MAX)"}


def check_dialect(name: str) -> str:
    dialect = name.strip().lower()
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {name!r}, known: {', '.join(DIALECTS)}")
    return dialect


def pair_rules(source: str, target: str) -> dict[str, str]:
    """Source type name to target type for one pair of dialects."""
    spelling = {**SPELLING[target], **PAIR_SPELLING.get((source, target), {})}
    skipped = PAIR_WITHOUT_RULE.get((source, target), ())
    return {
        name: spelling[kind]
        for name, kind in KIND_OF[source].items()
        if name not in skipped and kind in spelling
    }


@cache
def rule_rows() -> list[tuple[str, str, str, str]]:
    return [
        (source, name, target, spelled)
        for source in DIALECTS
        for target in DIALECTS
        if source != target
        for name, spelled in pair_rules(source, target).items()
    ]


def type_rules(spark: SparkSession) -> DataFrame:
    """All rules as a table; its size is fixed (about 400 rows)."""
    return spark.createDataFrame(
        rule_rows(),
        "source_dialect string, source_type string, target_dialect string, target_type string",
    )


def translate_types(
    columns: DataFrame,
    source: str | Column,
    target: str | Column,
    type_column: str = "data_type",
    user_defined_column: str | None = None,
    output: str = "target_type",
) -> DataFrame:
    """Add the target type of every row of a catalog table.

    Same dialect: unchanged. Arrays: the target's array type. Otherwise the
    exact rule, then the rule of the name before the bracket with its length
    kept, then the default string type. User-defined types are always the
    default string type. Both dialects may be columns; the rules are joined
    by broadcast (fixed size), so the catalog rows are not shuffled.
    """
    spark = columns.sparkSession
    source_col = F.lit(check_dialect(source)) if isinstance(source, str) else source
    target_col = F.lit(check_dialect(target)) if isinstance(target, str) else target

    raw = F.col(type_column)
    name = F.lower(F.trim(raw))
    length = F.regexp_extract(name, r"\([^)]*\)", 0)
    base = F.trim(F.substring_index(name, "(", 1))
    pairs = [(s, t, pair_rules(s, t)) for s in DIALECTS for t in DIALECTS if s != t]
    rules = spark.createDataFrame(
        pairs, "source_dialect string, target_dialect string, _rules map<string,string>"
    )

    staged = columns.withColumns({"_source": source_col, "_target": target_col})
    joined = staged.join(
        F.broadcast(rules),
        (F.col("_source") == F.col("source_dialect")) & (F.col("_target") == F.col("target_dialect")),
        "left",
    )
    default = F.element_at(_literal_map(DEFAULT_STRING), F.col("_target"))
    array_type = F.coalesce(F.element_at(_literal_map(ARRAY_TYPE), F.col("_target")), raw)
    exact = F.element_at("_rules", name)
    by_base = F.element_at("_rules", base)
    with_length = F.when(F.contains(by_base, F.lit("(")), by_base).otherwise(F.concat(by_base, length))
    result = (
        F.when(F.col("_source") == F.col("_target"), raw)
        .when(F.endswith(name, F.lit("[]")), array_type)
        .otherwise(F.coalesce(exact, with_length, default))
    )
    if user_defined_column:
        result = F.when(F.col(user_defined_column), default).otherwise(result)
    return joined.select(*[F.col(c) for c in columns.columns], result.alias(output))


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def translate_type(type_text: str, source: str, target: str, user_defined: bool = False) -> str:
    """One type, for plans built on the driver from a table's schema."""
    source, target = check_dialect(source), check_dialect(target)
    if user_defined:
        return DEFAULT_STRING[target]
    if source == target:
        return type_text
    name = type_text.lower().strip()
    if name.endswith("[]"):
        return ARRAY_TYPE.get(target, type_text)
    rules = pair_rules(source, target)
    if name in rules:
        return rules[name]
    base, bracket, rest = name.partition("(")
    spelled = rules.get(base.strip(), DEFAULT_STRING[target])
    if bracket and base.strip() in rules and "(" not in spelled:
        return spelled + "(" + rest.partition(")")[0] + ")"
    return spelled


# ---------------------------------------------------------------------------
# Spark types
# ---------------------------------------------------------------------------

# Spark type per kind of a target column.
_SPARK_KIND = {
    "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "serial32": T.IntegerType(), "serial64": T.LongType(), "boolean": T.BooleanType(),
    "float32": T.FloatType(), "float64": T.DoubleType(), "approximate": T.DoubleType(),
    "decimal": T.DecimalType(38, 18), "money": T.DecimalType(19, 4),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
    "bytes": T.BinaryType(),
}

# Spellings used on targets that are not source names of that dialect.
_EXTRA_KIND = {
    POSTGRESQL: {"timestamptz": "timestamptz", "int": "int32", "bytea": "bytes"},
    MYSQL: {"integer": "int32", "double precision": "float64", "numeric": "decimal"},
    SNOWFLAKE: {"decimal": "decimal", "numeric": "decimal", "int": "int32"},
    SQLITE: {},
    SQLSERVER: {"integer": "int32"},
}


def spark_type(type_text: str, dialect: str) -> T.DataType:
    """The Spark type a column of this SQL type is held in.

    Types without a Spark counterpart (time, interval, json, uuid, …) are
    text. SQLite stores integers in 64 bits.
    """
    dialect = check_dialect(dialect)
    text = re.sub(r"\s+(auto_?increment|identity.*)$", "", type_text.lower().strip())
    if text.endswith("[]"):
        return T.ArrayType(spark_type(text[:-2], dialect))
    if dialect == MYSQL and text == "tinyint(1)":
        return T.BooleanType()
    base = re.sub(r"\s*\([^)]*\)", "", text).strip()
    names = {**_EXTRA_KIND[dialect], **KIND_OF[dialect]}
    kind = names.get(base)
    if dialect == SQLITE and kind == "int32":
        return T.LongType()
    if kind == "decimal":
        size = re.search(r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", text)
        if size:
            return T.DecimalType(int(size.group(1)), int(size.group(2) or 0))
    return _SPARK_KIND.get(kind, T.StringType())


def sql_type(dtype: T.DataType) -> str:
    """PostgreSQL spelling of a Spark type, the starting point of translation.

    Fixed values: tables read from Parquet or Spark carry no dialect of their
    own, so their columns start from these names.
    """
    if isinstance(dtype, T.DecimalType):
        return f"numeric({dtype.precision},{dtype.scale})"
    if isinstance(dtype, T.ArrayType):
        return sql_type(dtype.elementType) + "[]"
    names = {
        T.BooleanType: "boolean", T.ByteType: "smallint", T.ShortType: "smallint",
        T.IntegerType: "integer", T.LongType: "bigint", T.FloatType: "real",
        T.DoubleType: "double precision", T.DateType: "date",
        T.TimestampType: "timestamp with time zone",
        T.TimestampNTZType: "timestamp without time zone", T.BinaryType: "bytea",
        T.StructType: "jsonb", T.MapType: "jsonb", T.VariantType: "jsonb",
    }
    return names.get(type(dtype), "text")
