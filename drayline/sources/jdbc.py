"""Database tables over JDBC.

Drivers are supplied by the user as jars. A scan is split by ranges of a
numeric or date column, or by hash predicates of the key; the fetch size keeps
a task from holding a whole result. Options with credentials go only to the
reader and are stored nowhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.plans.dialects import MYSQL, POSTGRESQL, SNOWFLAKE, SQLITE, SQLSERVER, check_dialect
from drayline.sources.catalog import resolve_types

# Rows per fetch, driver classes and hash expressions.
FETCH_ROWS = 10_000
DRIVERS = {
    POSTGRESQL: "org.postgresql.Driver",
    MYSQL: "com.mysql.cj.jdbc.Driver",
    SNOWFLAKE: "net.snowflake.client.jdbc.SnowflakeDriver",
    SQLITE: "org.sqlite.JDBC",
    SQLSERVER: "com.microsoft.sqlserver.jdbc.SQLServerDriver",
}
_HASH_BUCKET = {
    POSTGRESQL: "mod(abs(hashtext(cast({key} as text))::bigint), {n})",
    MYSQL: "mod(crc32(cast({key} as char)), {n})",
    SNOWFLAKE: "mod(abs(hash({key})), {n})",
    SQLITE: "abs({key}) % {n}",
    SQLSERVER: "abs(cast(checksum({key}) as bigint)) % {n}",
}
_SYSTEM_SCHEMAS = "('information_schema', 'pg_catalog', 'mysql', 'performance_schema', 'sys', 'INFORMATION_SCHEMA')"


@dataclass(frozen=True)
class Database:
    """Where a database is and how to reach it."""

    dialect: str
    url: str
    options: Mapping[str, str] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        check_dialect(self.dialect)

    def reader_options(self) -> dict[str, str]:
        return {
            "url": self.url,
            "driver": DRIVERS[self.dialect],
            "fetchsize": str(FETCH_ROWS),
            **self.options,
        }

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self.reader_options()).option("query", sql).load()


def quote_column(name: str, dialect: str) -> str:
    opening, closing = {MYSQL: "``", SQLSERVER: "[]"}.get(dialect, '""')
    return opening + name + closing


def quote(name: str, dialect: str) -> str:
    """A possibly qualified name in the quotes of its dialect."""
    return ".".join(quote_column(part, dialect) for part in name.split("."))


def hash_predicates(dialect: str, key: str, parts: int) -> list[str]:
    """One WHERE condition per part; together they cover every row once."""
    bucket = _HASH_BUCKET[dialect].format(key=quote(key, dialect), n=parts)
    first = f"{bucket} = 0 or {quote(key, dialect)} is null"
    return [first] + [f"{bucket} = {i}" for i in range(1, parts)]


@dataclass(frozen=True)
class Cuts:
    """Where a column is cut into parts of about equal rows; ``heavy`` values fill a part or more each."""

    points: tuple
    heavy: dict


def depth_cuts(values: DataFrame, column: str, parts: int) -> Cuts:
    """Equi-depth cuts of a column by its quantiles, one mergeable sketch per task.

    A value that several quantiles fall on is heavy; it is counted as so many parts. NULLs don't count. The
    column is a number, a date or a timestamp; texts are split by a hash.
    """
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return Cuts((), {})
    found = values.agg(F.percentile_approx(F.col(f"`{column}`"), shares, 20 * parts).alias("q")).first()["q"] or []
    times = Counter(found)
    return Cuts(tuple(sorted(times)), {v: n for v, n in times.items() if n > 1})


def literal(value: object) -> str:
    """A value of a cut in SQL."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def cut_predicates(dialect: str, column: str, cuts: Cuts, hash_key: str | None = None) -> list[str]:
    """One WHERE condition per part; together they cover every row once.

    Heavy values and NULLs have parts of their own; with ``hash_key`` a heavy value has as many as it fills.
    """
    name = quote(column, dialect)
    above = [f"{name} {'>' if p in cuts.heavy else '>='} {literal(p)}" for p in cuts.points]
    below = [f"{name} < {literal(p)}" for p in cuts.points]
    ranges = [" and ".join(both) for both in zip(above, below[1:], strict=False)]
    found = [f"{name} is null", *below[:1], *ranges, *above[-1:]] if cuts.points else [f"{name} is null", f"{name} is not null"]
    for value, times in cuts.heavy.items():
        one = f"{name} = {literal(value)}"
        found += [f"{one} and ({p})" for p in hash_predicates(dialect, hash_key, times)] if hash_key else [one]
    return found


def read_table(
    spark: SparkSession,
    database: Database,
    table: str,
    range_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    hash_key: str | None = None,
    parts: int | None = None,
    balanced: bool = False,
) -> DataFrame:
    """Scan a table in parallel.

    With ``range_column`` its bounds are asked from the database when not
    given; with ``hash_key`` the parts are hash buckets. ``balanced`` reads the
    range column alone first (in hash buckets, if there is a key for them) and
    cuts it into parts of equal rows instead of equal width. Filters and
    column selections on the result are pushed to the database.
    """
    options = database.reader_options()
    quoted = quote(table, database.dialect)
    parts = parts or spark.sparkContext.defaultParallelism
    reader = spark.read.format("jdbc").options(**options).option("dbtable", quoted)
    properties = {k: v for k, v in options.items() if k != "url"}
    if range_column and balanced:
        first = hash_predicates(database.dialect, hash_key, parts) if hash_key else ["1 = 1"]
        values = spark.read.jdbc(database.url, quoted, predicates=first, properties=properties).select(f"`{range_column}`")
        predicates = cut_predicates(database.dialect, range_column, depth_cuts(values, range_column, parts), hash_key)
        return spark.read.jdbc(database.url, quoted, predicates=predicates, properties=properties)
    if range_column:
        if bounds is None:
            column = quote(range_column, database.dialect)
            ends = database.query(spark, f"select min({column}) lo, max({column}) hi from {quoted}")
            bounds = tuple(ends.first())
        if bounds[0] is None:
            return reader.load()
        return (
            reader.option("partitionColumn", range_column)
            .option("lowerBound", str(bounds[0]))
            .option("upperBound", str(bounds[1]))
            .option("numPartitions", str(parts))
            .load()
        )
    if hash_key:
        predicates = hash_predicates(database.dialect, hash_key, parts)
        return spark.read.jdbc(database.url, quoted, predicates=predicates, properties=properties)
    return reader.load()


def table_names(spark: SparkSession, database: Database, schemas: Sequence[str] = ()) -> DataFrame:
    """Base tables as ``schema.table``, sorted."""
    if database.dialect == SQLITE:
        sql = "select name as table_name from sqlite_master where type = 'table' and name not like 'sqlite_%'"
        return database.query(spark, sql).orderBy("table_name")
    sql = (
        "select table_schema as s, table_name as t from information_schema.tables "
        f"where table_type = 'BASE TABLE' and table_schema not in {_SYSTEM_SCHEMAS}"
    )
    found = database.query(spark, sql)
    if schemas:
        found = found.where(F.col("s").isin(list(schemas)))
    return found.select(F.concat_ws(".", "s", "t").alias("table_name")).orderBy("table_name")


def column_listing(spark: SparkSession, database: Database, table: str) -> DataFrame:
    """Columns of one table with type, nullability, default and key flag."""
    schema, _, bare = table.rpartition(".")
    where = f"c.table_name = '{_escape(bare)}'" + (f" and c.table_schema = '{_escape(schema)}'" if schema else "")
    if database.dialect == SQLITE:
        sql = (
            "select cid + 1 as ordinal, name as column_name, type as data_type, \"notnull\" = 0 as is_nullable, "
            f"dflt_value as column_default, pk > 0 as is_pk, pk as pk_position from pragma_table_info('{_escape(table)}')"
        )
        return database.query(spark, sql).withColumn("is_user_defined", F.lit(False))
    udt = "c.udt_name" if database.dialect == POSTGRESQL else "null"
    sql = (
        "select c.ordinal_position as ordinal, c.column_name as column_name, c.data_type as data_type, "
        f"{udt} as udt_name, c.is_nullable as nullable_text, c.column_default as column_default, "
        "k.ordinal_position as pk_position "
        "from information_schema.columns c left join (select u.table_schema, u.table_name, u.column_name, "
        "u.ordinal_position from information_schema.key_column_usage u "
        "join information_schema.table_constraints t on t.constraint_name = u.constraint_name "
        "and t.table_schema = u.table_schema and t.table_name = u.table_name "
        "where t.constraint_type = 'PRIMARY KEY') k on k.table_schema = c.table_schema "
        f"and k.table_name = c.table_name and k.column_name = c.column_name where {where}"
    )
    listed = database.query(spark, sql)
    return resolve_types(listed).select(
        "ordinal",
        "column_name",
        "data_type",
        (F.col("nullable_text") == "YES").alias("is_nullable"),
        "column_default",
        F.col("pk_position").isNotNull().alias("is_pk"),
        "pk_position",
        "is_user_defined",
    )


def reference_listing(spark: SparkSession, database: Database) -> DataFrame:
    """Child and parent tables of all foreign keys, both as ``schema.table``."""
    if database.dialect == SQLITE:
        sql = (
            'select m.name as child, f."table" as parent from sqlite_master m '
            "join pragma_foreign_key_list(m.name) f where m.type = 'table'"
        )
    elif database.dialect == MYSQL:
        sql = (
            "select concat(table_schema, '.', table_name) as child, "
            "concat(referenced_table_schema, '.', referenced_table_name) as parent "
            "from information_schema.key_column_usage where referenced_table_name is not null"
        )
    else:
        sql = (
            "select concat(c.table_schema, '.', c.table_name) as child, "
            "concat(p.table_schema, '.', p.table_name) as parent "
            "from information_schema.referential_constraints r "
            "join information_schema.table_constraints c on c.constraint_name = r.constraint_name "
            "and c.constraint_schema = r.constraint_schema "
            "join information_schema.table_constraints p on p.constraint_name = r.unique_constraint_name "
            "and p.constraint_schema = r.unique_constraint_schema"
        )
    return database.query(spark, sql)


def _escape(text: str) -> str:
    return text.replace("'", "''")
