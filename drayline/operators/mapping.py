"""Apply a table spec to a DataFrame in one projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.functions.dates import convert_date
from drayline.functions.nested import flatten_nested
from drayline.functions.rules import Cell, Stages, apply_chain
from drayline.functions.text import as_text, strip, text_to_bigint, text_to_double
from drayline.plans.dialects import DEFAULT_STRING, POSTGRESQL, spark_type, sql_type, translate_type
from drayline.plans.spec import TRANSFORM, ColumnMapping, TableSpec

ON_ERROR = ("fail", "null", "reject")
FAULTS = "_faults"
FAULTY = "_faulty"
FAULT_TYPE = "array<struct<column:string,rule:string,value:string>>"


@dataclass(frozen=True)
class Mapped:
    """Rows that fit, and the rejected ones with what was wrong.

    Both are lazy plans over the same scan; write them with one job each, or
    write ``tagged`` (all rows and their faults) once and split that.
    """

    rows: DataFrame
    rejects: DataFrame
    tagged: DataFrame


def cast_cell(cell: Cell, wanted: T.DataType, rule: str) -> Cell:
    """Bring a cell to a Spark type; a value that does not fit is a fault."""
    have = cell.dtype
    if have == wanted:
        return cell
    if isinstance(wanted, T.StringType):
        return cell.to(as_text(cell.value, have), wanted)
    if isinstance(have, T.StringType):
        # Blank text is a missing value for every type but text.
        text = F.when(strip(cell.value) != "", cell.value)
        if isinstance(wanted, T.DoubleType):
            value = text_to_double(text)
        elif isinstance(wanted, T.LongType):
            value = text_to_bigint(text)
        elif isinstance(wanted, T.BinaryType):
            return cell.to(cell.value.cast("binary"), wanted)
        elif isinstance(wanted, (T.ArrayType, T.MapType, T.StructType)):
            value = F.from_json(text, wanted)
        else:
            value = strip(text).try_cast(wanted)
        source = text
    elif isinstance(have, T.BooleanType) and isinstance(wanted, T.NumericType):
        return cell.to(cell.value.cast(wanted), wanted)
    elif isinstance(wanted, T.BooleanType) and isinstance(have, T.NumericType):
        return cell.to(cell.value != 0, wanted)
    else:
        source = cell.value
        value = cell.value.try_cast(wanted)
    return cell.convert(rule, source, value, wanted)


def shaped_cell(
    df: DataFrame,
    mapping: ColumnMapping,
    spec: TableSpec,
    keep_arrays: bool,
    stages: Stages | None = None,
) -> Cell:
    """A mapping's cell with default, rules and nesting applied, before its target type."""
    dtype = df.schema[mapping.source].dataType
    cell = Cell(F.col(f"`{mapping.source}`"), dtype, mapping.source, stages)
    if mapping.source in spec.defaults:
        filled = F.coalesce(cell.value, F.lit(spec.defaults[mapping.source]).cast(dtype))
        cell = cell.to(filled, dtype)
    if mapping.action == TRANSFORM:
        if mapping.is_date:
            cell = convert_date(cell, *mapping.formats)
        else:
            cell = apply_chain(cell, mapping.rules, strict=spec.strict_rules)
    value, flat_type = flatten_nested(cell.value, cell.dtype, keep_arrays)
    return cell.to(value, flat_type)


def target_type(mapping: ColumnMapping, dtype: T.DataType, spec: TableSpec) -> str | None:
    """The SQL type a shaped cell is cast to, for dry runs and loads alike.

    A user-defined type becomes text, a named type wins, else the type is
    translated when the table has a target dialect.
    """
    if mapping.source in spec.user_defined:
        return DEFAULT_STRING[spec.target_dialect or POSTGRESQL]
    if mapping.target_type or not spec.target_dialect:
        return mapping.target_type or None
    return translate_type(sql_type(dtype), POSTGRESQL, spec.target_dialect)


def keeps_arrays(spec: TableSpec) -> bool:
    return (spec.target_dialect or POSTGRESQL) == POSTGRESQL


def build_cell(
    df: DataFrame,
    mapping: ColumnMapping,
    spec: TableSpec,
    keep_arrays: bool,
    stages: Stages | None = None,
) -> Cell:
    """The target cell of one mapping."""
    cell = shaped_cell(df, mapping, spec, keep_arrays, stages)
    wanted = target_type(mapping, cell.dtype, spec)
    if wanted:
        wanted_type = spark_type(wanted, spec.target_dialect or POSTGRESQL)
        cell = cast_cell(cell, wanted_type, f"cast to {wanted}")
    return cell


def _fault_array(cells: dict[str, Cell]) -> Column:
    entries = [
        F.when(
            fault.when,
            F.struct(
                F.lit(column).alias("column"),
                F.lit(fault.rule).alias("rule"),
                fault.value.cast("string").alias("value"),
            ),
        )
        for column, cell in cells.items()
        for fault in cell.faults
    ]
    if not entries:
        return F.array().cast(FAULT_TYPE)
    return F.filter(F.array(*entries), lambda x: x.isNotNull()).cast(FAULT_TYPE)


def apply_spec(df: DataFrame, spec: TableSpec, on_error: str = "fail") -> Mapped:
    """Rename, clean, retype and flatten all columns of a table.

    ``on_error``: ``fail`` raises on the first cell a rule cannot take,
    ``null`` writes NULL there, ``reject`` sends the row to ``rejects`` with
    column, rule and value. Everything is one projection over the scan.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {', '.join(ON_ERROR)}")
    keep_arrays = keeps_arrays(spec)
    stages = None if on_error == "fail" else Stages()
    cells: dict[str, Cell] = {}
    for mapping in spec.for_columns(df.columns):
        if mapping.name in cells:
            raise ValueError(f"{spec.name}: two columns are named {mapping.name}")
        cells[mapping.name] = build_cell(df, mapping, spec, keep_arrays, stages)
    values = [cell.value.alias(name) for name, cell in cells.items()]

    if stages is None:
        rows = df.select(*values)
        empty = rows.limit(0).withColumn(FAULTS, F.array().cast(FAULT_TYPE))
        return Mapped(rows, empty, empty)
    for level in stages.levels:
        df = df.select("*", *[value.alias(name) for name, value in level.items()])
    faulty = reduce(
        lambda a, b: a | b, [f.when for cell in cells.values() for f in cell.faults], F.lit(False)
    )
    faults = _fault_array(cells).alias(FAULTS)
    rejects = _settled(df, [*values, faults, faulty.alias(FAULTY)]).where(FAULTY).drop(FAULTY)
    tagged = df.select(*values, faults)
    if on_error == "null":
        return Mapped(df.select(*values), rejects, tagged)
    kept = _settled(df, [*values, faulty.alias(FAULTY)]).where(~F.col(FAULTY)).drop(FAULTY)
    return Mapped(kept, rejects, tagged)


def split_tagged(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects of tagged rows that were written once."""
    faulty = F.size(FAULTS) > 0
    return tagged.where(~faulty).drop(FAULTS), tagged.where(faulty)


def _settled(df: DataFrame, columns: list[Column]) -> DataFrame:
    """A projection that a later filter on its columns stays above.

    Filters move below a plain projection, with every expression they use
    copied, so all casts of a row would run twice. They do not move below a
    generator; this one makes one row of one row.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def apply_rules(df: DataFrame, column: str, chain, output: str | None = None) -> DataFrame:
    """One chain on one column, raising on cells it cannot take."""
    cell = apply_chain(Cell(F.col(f"`{column}`"), df.schema[column].dataType, column), chain)
    return df.withColumn(output or column, cell.value)


def cast_columns(df: DataFrame, types: dict[str, str], dialect: str, on_error: str = "fail") -> Mapped:
    """Give columns the physical types of a target dialect."""
    mappings = [ColumnMapping(c, target_type=t) for c, t in types.items()]
    spec = TableSpec("cast", mappings, target_dialect=dialect)
    return apply_spec(df, spec, on_error)


def fault_summary(mapped: Mapped) -> DataFrame:
    """Rejected cells per column and rule."""
    fault = F.explode(FAULTS).alias("f")
    return (
        mapped.tagged.select(fault)
        .groupBy(F.col("f.column").alias("column"), F.col("f.rule").alias("rule"))
        .agg(F.count("*").alias("cells"))
    )
