import pytest

from drayline.functions.dates import spark_pattern
from drayline.operators.mapping import apply_spec
from drayline.plans.spec import ColumnMapping, TableSpec


@pytest.mark.parametrize(
    "given, expected",
    [
        ("YYYY-MM-DD HH:mm:ss", "yyyy-M-d H:m:s"),
        ("YYYYMMDD", "yyyyMMdd"),
        ("DD/MM/YYYY", "d/M/yyyy"),
        ("YYYY-MM-DDTHH:mm", "yyyy-M-d'T'H:m"),
        ("%d.%m.%Y %H:%M:%S.%f", "d.M.yyyy H:m:s.SSSSSS"),
        (" HHmm ", "HHmm"),
    ],
)
def test_pattern(given, expected):
    assert spark_pattern(given) == expected


def convert(spark, texts, source=None, target=None, on_error="fail"):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, d string")
    mapping = ColumnMapping("d", "d", "transform", source_format=source, target_format=target)
    mapped = apply_spec(df, TableSpec("t", [mapping]), on_error)
    return [r.d for r in mapped.rows.orderBy("id").collect()]


TEXTS = [
    "2024-01-15 09:30:00", "2024-01-15 09:30:00.123456789", "2024-01-15", "2024-01-15T09:30:00",
    "2024-3-5 1:2:3", " 2024-01-15 09:30:00 ", "", "   ", None, "soon", "2024-13-45", "2024-01-15 09:30:00 x",
]


def test_iso(spark):
    assert convert(spark, TEXTS) == [
        "2024-01-15T09:30:00Z", "2024-01-15T09:30:00Z", "2024-01-15T00:00:00Z", "2024-01-15T09:30:00Z",
        "2024-03-05T01:02:03Z", "2024-01-15T09:30:00Z", None, None, None, "soon", "2024-13-45",
        "2024-01-15 09:30:00 x",
    ]


def test_unix(spark):
    assert convert(spark, ["2024-01-15 09:30:00", None], target="UNIX") == [1705311000, None]
    with pytest.raises(Exception, match="cannot take soon"):
        convert(spark, ["soon"], target="UNIX")
    assert convert(spark, ["soon", "1969-12-31 23:59:59"], target="UNIX", on_error="null") == [None, -1]


def test_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert convert(spark, ["2024-07-15 09:30:00"]) == ["2024-07-15T09:30:00Z"]
        assert convert(spark, ["2024-01-15 09:30:00", "2024-07-15 09:30:00"], target="UNIX") == [1705311000, 1721035800]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_other_formats(spark):
    assert convert(spark, ["15/01/2024", "2024-01-15"], "DD/MM/YYYY", "YYYY-MM-DD") == ["2024-01-15"] * 2
    assert convert(spark, ["20240115"], "YYYYMMDD", "YYYY-MM-DD") == ["2024-01-15"]
    assert convert(spark, ["2024-01-15 09:30:00.5"], target="plain") == ["2024-01-15T09:30:00.500000"]


def test_typed_values(spark):
    df = spark.sql("select date'2024-01-15' d, timestamp'2024-01-15 09:30:00' t, timestamp_ntz'2024-01-15 09:30:00' n")
    maps = [ColumnMapping(c, action="transform") for c in "dtn"]
    row = apply_spec(df, TableSpec("t", maps)).rows.first()
    assert list(row) == ["2024-01-15T00:00:00Z", "2024-01-15T09:30:00+0000", "2024-01-15T09:30:00Z"]
