"""Column types from text cells in one aggregation.

Every cell gets a rank; a column's ranks are or-ed into a bit set, which
combines before the shuffle, so one small row per task leaves each scan. The
bit set holds all that is needed: nullability, the widest type, and whether
types were mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.functions.text import ANY_NUMBER, WHOLE_NUMBER, as_text, strip, strip_column

# Kinds of a cell in widening order, their SQL names, and the
# pattern of an ISO date or date-time.
NULL, BOOLEAN, INTEGER, FLOAT, TIMESTAMP, TEXT = range(6)
SQL_NAMES = {
    BOOLEAN: "BOOLEAN", INTEGER: "BIGINT", FLOAT: "DOUBLE PRECISION", TIMESTAMP: "TIMESTAMP",
    TEXT: "TEXT",
}
ISO_DATE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}"
    r"(:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?)?$"
)

LATTICES = ("ordered", "strict")


def text_rank(text: Column) -> Column:
    """Kind of one text cell."""
    return stripped_rank(strip(text))


def stripped_rank(s: Column) -> Column:
    """Kind of a cell whose outer blanks are off."""
    return (
        F.when(s.isNull() | (s == ""), NULL)
        .when(s.rlike(WHOLE_NUMBER), INTEGER)
        .when(s.rlike(ANY_NUMBER), FLOAT)
        .when(s.rlike(ISO_DATE), TIMESTAMP)
        .when((F.octet_length(s) <= 5) & F.lower(s).isin("true", "false"), BOOLEAN)
        .otherwise(TEXT)
    )


def native_rank(dtype: T.DataType) -> int | None:
    """Kind of all cells of a typed column (I4); None when the text decides."""
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.IntegralType):
        return INTEGER
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP
    return None


def variant_rank(value: Column) -> Column:
    """Kind of a JSON value held as a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), NULL)
        .when(kind == "BOOLEAN", BOOLEAN)
        .when(kind == "BIGINT", INTEGER)
        .when((kind == "DOUBLE") | (kind == "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), FLOAT)
        .when(kind == "STRING", text_rank(F.try_variant_get(value, "$", "string")))
        .otherwise(TEXT)
    )


def rank_bits(rank: Column) -> Column:
    """Bit set of all kinds seen.

    The maximum adds nothing to the set. It makes the plan refer to the rank
    twice, so the optimizer keeps it as a computed column; merged into the
    or-aggregate, which mentions its input three times, the patterns of a
    rank would run three times per cell.
    """
    bit = F.call_function("shiftleft", F.lit(1), rank)
    return F.bit_or(bit).bitwiseOR(F.call_function("shiftleft", F.lit(1), F.max(rank)))


def decode_bits(bits: Column, lattice: str = "ordered") -> Column:
    """SQL type for a column's bit set.

    ``ordered`` takes the widest kind seen, in the order boolean, integer,
    float, timestamp, text. ``strict`` widens integer to float only; any
    other mixture is text.
    """
    if lattice not in LATTICES:
        raise ValueError(f"lattice must be one of {', '.join(LATTICES)}")
    seen = bits.bitwiseAND(F.lit(~1 & 0b111111))
    if lattice == "strict":
        result = F.when(seen == 1 << BOOLEAN, SQL_NAMES[BOOLEAN])
        result = result.when(seen == 1 << INTEGER, SQL_NAMES[INTEGER])
        result = result.when(seen.isin(1 << FLOAT, 1 << INTEGER | 1 << FLOAT), SQL_NAMES[FLOAT])
        result = result.when(seen == 1 << TIMESTAMP, SQL_NAMES[TIMESTAMP])
        return result.otherwise(SQL_NAMES[TEXT])
    result = F.when(seen >= 1 << TEXT, SQL_NAMES[TEXT])
    for rank in (TIMESTAMP, FLOAT, INTEGER, BOOLEAN):
        result = result.when(seen >= 1 << rank, SQL_NAMES[rank])
    return result.otherwise(SQL_NAMES[TEXT])


def infer_types(df: DataFrame, lattice: str = "ordered", sample_rows: int | None = None) -> DataFrame:
    """Column name, position, type and nullability of a table.

    Reads all rows unless ``sample_rows`` is given (I6), so late values are
    not lost. The result has one row per column.
    """
    if sample_rows is not None:
        df = df.limit(sample_rows)
    fields = df.schema.fields
    natives = [native_rank(f.dataType) for f in fields]
    cells = df.select(
        *[
            as_text(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}")
            if native is None
            else F.when(F.col(f"`{f.name}`").isNull(), NULL).otherwise(native).alias(f"c{i}")
            for i, (f, native) in enumerate(zip(fields, natives))
        ]
    )
    stripped = cells.select(
        *[F.col(f"c{i}") if n is not None else strip_column(f"c{i}").alias(f"c{i}") for i, n in enumerate(natives)]
    )
    ranks = stripped.select(
        *[
            (F.col(f"c{i}") if n is not None else stripped_rank(F.col(f"c{i}"))).alias(f"r{i}")
            for i, n in enumerate(natives)
        ]
    )
    bits = ranks.agg(*[rank_bits(F.col(f"r{i}")).alias(f"b{i}") for i in range(len(fields))])
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("column_name"),
                F.coalesce(F.col(f"b{i}"), F.lit(0)).alias("bits"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return bits.select(F.inline(entries)).select(
        "ordinal",
        "column_name",
        decode_bits(F.col("bits"), lattice).alias("data_type"),
        (F.col("bits").bitwiseAND(F.lit(1)) == 1).alias("is_nullable"),
    )


def infer_record_keys(
    records: DataFrame,
    json_column: str = "record",
    position: list[str] | None = None,
    group_by: list[str] | None = None,
    lattice: str = "ordered",
) -> DataFrame:
    """Keys of JSON records with type, nullability and first-seen order.

    ``position`` names the columns that order the records (such as file, block
    and line); a key's place is its first record and its place therein. A key
    some record lacks is nullable. With ``group_by`` (such as the file) every
    group gets its own schema, all in one aggregation (I9).
    """
    group_by = group_by or []
    order = [F.col(c) for c in position] if position else []
    text = F.col(json_column)
    # The NULL key stands for the record itself, so one pass also counts records.
    cells = (
        records.select(
            *[F.col(c) for c in group_by],
            *[c.alias(f"_o{i}") for i, c in enumerate(order)],
            F.json_object_keys(text).alias("_keys"),
            F.explode(
                F.concat(
                    F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value"))),
                    F.map_entries(F.parse_json(text).cast("map<string,variant>")),
                )
            ).alias("_e"),
        )
        .select(
            *group_by,
            *[f"_o{i}" for i in range(len(order))],
            F.col("_e.key").alias("_key"),
            F.array_position("_keys", F.col("_e.key")).alias("_place"),
            variant_rank(F.col("_e.value")).alias("_rank"),
        )
    )
    first_seen = F.struct(*[F.col(f"_o{i}") for i in range(len(order))], F.col("_place"))
    per_key = cells.groupBy(*group_by, "_key").agg(
        rank_bits(F.col("_rank")).alias("bits"),
        F.count("*").alias("n"),
        F.min(first_seen).alias("first_seen"),
    )
    named = per_key.where(F.col("_key").isNotNull())
    if group_by:
        totals = per_key.where(F.col("_key").isNull()).select(*group_by, F.col("n").alias("total"))
        named = named.join(totals, group_by)
        total = F.col("total")
    else:
        total = records.agg(F.count("*")).scalar()
    return named.select(
        *group_by,
        F.col("_key").alias("column_name"),
        decode_bits(F.col("bits"), lattice).alias("data_type"),
        ((F.col("bits").bitwiseAND(F.lit(1)) == 1) | (F.col("n") < total)).alias("is_nullable"),
        "first_seen",
    )


def inferred_types(schema_rows: DataFrame) -> dict[str, str]:
    """The inferred schema as a driver-side mapping: one entry per column."""
    rows = schema_rows.orderBy("ordinal").select("column_name", "data_type").collect()
    return {r.column_name: r.data_type for r in rows}
