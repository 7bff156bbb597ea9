import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.operators.mapping import cast_columns
from drayline.plans.dialects import DIALECTS, rule_rows, spark_type, sql_type, translate_type, translate_types
from drayline.plans.spec import default_mappings

PG, MY, SF, LITE, MS = DIALECTS

# Worked out by hand from each pair's rules.
CASES = [
    ("serial", PG, MY, "INT AUTO_INCREMENT"), ("boolean", PG, MY, "TINYINT(1)"),
    ("character varying(40)", PG, MY, "VARCHAR(255)"), ("numeric(10,4)", PG, MY, "DECIMAL(18,2)"),
    ("timestamp(3) without time zone", PG, MY, "DATETIME(3)"), ("cidr", PG, MY, "VARCHAR(45)"),
    ("text[]", PG, MY, "JSON"), ("mood", PG, MY, "VARCHAR(255)"), ("  UUID ", PG, MY, "CHAR(36)"),
    ("money", PG, SF, "NUMBER(19,4)"), ("varchar(12)", PG, SF, "VARCHAR(12)"), ("char", PG, SF, "CHAR(1)"),
    ("macaddr", PG, SF, "VARCHAR"), ("int4[]", PG, SF, "VARIANT"), ("jsonb", PG, LITE, "TEXT"),
    ("numeric(8,2)", PG, LITE, "REAL(8,2)"), ("text[]", PG, LITE, "TEXT"), ("text[]", PG, MS, "NVARCHAR(MAX)"),
    ("time with time zone", PG, MS, "DATETIMEOFFSET"), ("bigserial", PG, MS, "BIGINT IDENTITY(1,1)"),
    ("tinyint(1)", MY, PG, "SMALLINT(1)"), ("varchar(30)", MY, PG, "VARCHAR(30)"), ("enum('a','b')", MY, PG, "TEXT('a','b')"),
    ("year", MY, PG, "SMALLINT"), ("year", MY, SF, "VARCHAR"), ("decimal(10,2)", MY, SF, "NUMBER(10,2)"),
    ("tinyblob", MY, SF, "BINARY"), ("mediumblob", MY, SF, "BINARY"), ("mediumblob", MY, MS, "VARBINARY(MAX)"),
    ("float", MY, MS, "REAL"), ("bit", MY, PG, "BIT"), ("bit", MS, PG, "BOOLEAN"),
    ("number(38,0)", SF, PG, "NUMERIC(38,0)"), ("number", SF, MY, "DECIMAL"), ("char", SF, MY, "CHAR"),
    ("float", SF, MS, "REAL"), ("float", SF, PG, "DOUBLE PRECISION"), ("timestamp_ltz", SF, MS, "DATETIMEOFFSET"),
    ("real", LITE, SF, "FLOAT"), ("text", LITE, SF, "VARCHAR"), ("numeric", LITE, MY, "DECIMAL(18,2)"),
    ("blob", LITE, MS, "VARBINARY(MAX)"), ("real", LITE, MS, "FLOAT"), ("nvarchar(50)", MS, LITE, "TEXT(50)"),
    ("nvarchar(max)", MS, PG, "VARCHAR(max)"), ("datetimeoffset", MS, SF, "TIMESTAMP_TZ"), ("int", MS, LITE, "INTEGER"),
    ("anything(3)", PG, PG, "anything(3)"), ("text[]", MY, PG, "text[]"),
]


@pytest.mark.parametrize("given, source, target, expected", CASES)
def test_translate(given, source, target, expected):
    assert translate_type(given, source, target) == expected


def test_table_form_agrees_with_single_form(spark):
    df = spark.createDataFrame([(c[0], c[1], c[2], c[3]) for c in CASES], "data_type string, s string, t string, e string")
    rows = translate_types(df, F.col("s"), F.col("t")).collect()
    assert len(rows) == len(CASES)
    assert [(r.data_type, r.s, r.t) for r in rows if r.target_type != r.e] == []


def test_user_defined(spark):
    assert translate_type("mood", PG, PG, user_defined=True) == "TEXT"
    df = spark.createDataFrame([("mood", True), ("integer", False)], "data_type string, udt boolean")
    rows = translate_types(df, PG, MY, user_defined_column="udt").collect()
    assert {r.data_type: r.target_type for r in rows} == {"mood": "VARCHAR(255)", "integer": "INT"}


def test_rule_table():
    keys = [r[:3] for r in rule_rows()]
    assert len(keys) == len(set(keys)) == 378 + 25 + 7  # the two composed pairs add 5 and 20, blobs without a rule 7
    # No array type has a rule, every rule has a target.
    assert all(r[3] for r in rule_rows())


@pytest.mark.parametrize(
    "text, dialect, expected",
    [
        ("DECIMAL(18,2)", MY, T.DecimalType(18, 2)), ("NUMERIC", PG, T.DecimalType(38, 18)), ("NUMBER(10)", SF, T.DecimalType(10, 0)),
        ("TINYINT(1)", MY, T.BooleanType()), ("INTEGER", LITE, T.LongType()), ("INT AUTO_INCREMENT", MY, T.IntegerType()),
        ("BIGINT IDENTITY(1,1)", MS, T.LongType()), ("DATETIME2", MS, T.TimestampNTZType()), ("TIMESTAMPTZ", PG, T.TimestampType()),
        ("timestamp with time zone", PG, T.TimestampType()), ("VARCHAR(20)", PG, T.StringType()), ("JSONB", PG, T.StringType()),
        ("DOUBLE PRECISION", PG, T.DoubleType()), ("integer[]", PG, T.ArrayType(T.IntegerType())), ("BYTEA", PG, T.BinaryType()),
        ("FLOAT", MS, T.DoubleType()), ("FLOAT", MY, T.FloatType()), ("TEXT", LITE, T.StringType()),
    ],
)
def test_spark_type(text, dialect, expected):
    assert spark_type(text, dialect) == expected


def test_schema_to_dialect(spark):
    schema = spark.sql("select 1 a, 2.5D b, 'x' c, array(1) d, cast(1 as decimal(9,3)) e, timestamp_ntz'2024-01-01' f").schema
    assert [sql_type(f.dataType) for f in schema] == [
        "integer", "double precision", "text", "integer[]", "numeric(9,3)", "timestamp without time zone",
    ]
    assert [m.target_type for m in default_mappings(schema, MY)] == ["INT", "DOUBLE", "TEXT", "JSON", "DECIMAL(18,2)", "DATETIME"]


def test_casts(spark):
    cells = [("1", "2.5", "2024-01-31", "yes"), (" 1_0 ", "nan", " 2024-02-01 ", ""), ("", "", "", None), ("x", "1d", "31.1.", "t")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "id int, i string, f string, d string, b string")
    types = {"i": "BIGINT", "f": "DOUBLE PRECISION", "d": "DATE"}
    rows = cast_columns(df, types, PG, "null").rows.orderBy("id").collect()
    assert [r.i for r in rows] == [1, 10, None, None]
    assert rows[0].f == 2.5 and rows[1].f != rows[1].f and rows[3].f is None
    assert [str(r.d) for r in rows] == ["2024-01-31", "2024-02-01", "None", "None"]
    mapped = cast_columns(df, types, PG, "reject")
    assert mapped.rows.count() == 3
    assert [f.column for f in mapped.rejects.first()._faults] == ["i", "f", "d"]
