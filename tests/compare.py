"""Compare a Spark result with the result of its SQL twin."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, Decimal):
        return f"dec{value.normalize()}"
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def differences(df, con, sql: str) -> str | None:
    """None when columns and rows agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    expected = Counter(
        tuple(plain(row[names.index(n)]) for n in order) for row in result.fetchall()
    )
    columns = [f"`{n}`" for n in order]
    actual = Counter(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    if actual == expected:
        return None
    extra, lost = list((actual - expected).items())[:3], list((expected - actual).items())[:3]
    return (
        f"rows {sum(actual.values())} and {sum(expected.values())}; only Spark: {extra}; only SQL: {lost}"
    )[:3000]
