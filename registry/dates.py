"""Date conversion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from drayline.operators.mapping import apply_spec
from drayline.plans.spec import ColumnMapping, TableSpec
from registry import query, table


def _converted(rows, column, source_format=None, target_format=None):
    mapping = ColumnMapping(
        column, "value", "transform", source_format=source_format, target_format=target_format
    )
    return apply_spec(rows, TableSpec("dates", [mapping])).rows


@query("date_iso", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as value from events")
def date_iso(spark, sf_dir):
    return _converted(table(spark, sf_dir, "events").select("event_id", "ts"), "ts")


@query("date_unix", "select event_id, cast(floor(epoch(ts)) as bigint) as value from events")
def date_unix(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    return _converted(rows, "ts", target_format="UNIX")


@query("date_only", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as value from orders")
def date_only(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return _converted(rows, "o_orderdate", target_format="YYYY-MM-DD")


@query(
    "date_isoformat",
    "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as value from orders",
)
def date_isoformat(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return _converted(rows, "o_orderdate", target_format="other")


@query(
    "date_custom_format",
    "select event_id, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') as value from events",
)
def date_custom_format(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "d/M/yyyy HH:mm").alias("text")
    )
    return _converted(rows, "text", source_format="DD/MM/YYYY HH:mm")


@query(
    "date_compact_format",
    "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as value from orders",
)
def date_compact_format(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("text")
    )
    return _converted(rows, "text", "YYYYMMDD", "YYYY-MM-DD")


_MIXED_SQL = """
select event_id, case event_id % 7
    when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S')
    when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S.%f')
    when 2 then strftime(ts, '%Y-%m-%d')
    when 3 then strftime(ts, '%Y-%m-%dT%H:%M:%S')
    when 4 then 'n/a ' || event_type
    when 5 then '  '
    else strftime(ts, '%d/%m/%Y') end as v
from events
"""


def _mixed(spark, sf_dir):
    ts = F.col("ts")
    kind = F.col("event_id") % 7
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 4, F.concat(F.lit("n/a "), "event_type"))
        .when(kind == 5, F.lit("  "))
        .otherwise(F.date_format(ts, "dd/MM/yyyy"))
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query(
    "date_parse_fallback",
    f"""
    select event_id, case when trim(v) = '' then null else coalesce(strftime(coalesce(
        try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%Y-%m-%d %H:%M:%S'),
        try_strptime(v, '%Y-%m-%d %H:%M:%S.%f'), try_strptime(v, '%Y-%m-%d'),
        try_strptime(v, '%Y-%m-%dT%H:%M:%S')), '%Y-%m-%dT%H:%M:%SZ'), v) end as value
    from ({_MIXED_SQL})
    """,
)
def date_parse_fallback(spark, sf_dir):
    return _converted(_mixed(spark, sf_dir), "text", source_format="DD/MM/YYYY")


@query(
    "date_unix_rejects",
    f"select event_id, v as value from ({_MIXED_SQL}) where event_id % 7 = 4",
)
def date_unix_rejects(spark, sf_dir):
    """Texts that are no date cannot become a number; they are rejected."""
    mapping = ColumnMapping(
        "text", "value", "transform", source_format="DD/MM/YYYY", target_format="UNIX"
    )
    mapped = apply_spec(_mixed(spark, sf_dir), TableSpec("dates", [mapping]), on_error="reject")
    return mapped.rejects.select("event_id", F.col("_faults")[0]["value"].alias("value"))


_ZONED = """
select event_id, case event_id % 5
    when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') || '.123456+02:00'
    when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.5Z'
    when 2 then strftime(ts, '%Y-%m-%d %H:%M:%S') || '.123456 not a date'
    when 3 then strftime(ts, '%Y-%m-%d %H:%M:%S') || '.123456789'
    else strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-0330' end as value, ts from events
"""


@query(
    "date_zoned_text",
    f"select event_id, case event_id % 5 when 0 then strftime(ts - interval 2 hour, '%Y-%m-%dT%H:%M:%SZ') "
    "when 2 then value when 4 then strftime(ts + interval 210 minute, '%Y-%m-%dT%H:%M:%SZ') "
    f"else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as value from ({_ZONED})",
)
def date_zoned_text(spark, sf_dir):
    """The whole text is parsed, fraction and zone included; text with something behind the date stays."""
    whole = F.date_trunc("second", "ts")
    second, gap = F.date_format(whole, "yyyy-MM-dd HH:mm:ss"), F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.concat(second, F.lit(".123456+02:00")))
        .when(kind == 1, F.concat(gap, F.lit(".5Z")))
        .when(kind == 2, F.concat(second, F.lit(".123456 not a date")))
        .when(kind == 3, F.concat(second, F.lit(".123456789")))
        .otherwise(F.concat(gap, F.lit("-0330")))
    )
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("value"))
    return _converted(rows, "value").select("event_id", "value")
