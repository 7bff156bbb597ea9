"""Files to tables: list, select, read, infer, load."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.operators.mapping import FAULT_TYPE, FAULTS
from drayline.operators.progress import RunHistory
from drayline.plans.load import LoadOptions, LoadResult, dry_run, load_tables
from drayline.plans.spec import TableSpec
from drayline.sinks.external import ExternalTarget
from drayline.sources.files import RECORD, SURPLUS, csv_rows, csv_surplus, plain_path, read_files, typed
from drayline.sources.listing import list_files, select_names
from drayline.sources.workbooks import workbook_rows, workbook_surplus

# Formats whose cells are text and get their types by inference.
_TEXT_FORMATS = ("csv", "json", "jsonl", "xlsx")
# Formats whose rows may have more cells than their header, and those rows.
_SURPLUS_ROWS = {"csv": csv_surplus, "xlsx": workbook_surplus}
_EVERY_ROW = {"csv": csv_rows, "xlsx": workbook_rows}


def file_tables(
    spark: SparkSession,
    path: str,
    file_format: str | None = None,
    selected: Iterable[str] = (),
    recursive: bool = False,
    lattice: str = "ordered",
    on_error: str = "reject",
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """One typed DataFrame per table name, and the rows that did not fit.

    Files of the same name and format make one table in one read. Only file
    names reach the driver; text files are scanned once for their types.
    """
    return _read_tables(spark, path, file_format, selected, recursive, lattice, on_error)[:2]


def _read_tables(
    spark: SparkSession,
    path: str,
    file_format: str | None = None,
    selected: Iterable[str] = (),
    recursive: bool = False,
    lattice: str = "ordered",
    on_error: str = "reject",
) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    """What ``file_tables`` returns, and all rows of the files by table, to be counted."""
    listing = select_names(list_files(spark, path, file_format, recursive), selected, "table_name")
    grouped: dict[str, dict[str, list[str]]] = {}
    for row in listing.orderBy("path").select("table_name", "format", "path").toLocalIterator():
        grouped.setdefault(row.table_name, {}).setdefault(row.format, []).append(plain_path(row.path))
    tables, rejects, unfiltered = {}, {}, {}
    for name, formats in grouped.items():
        frames = [read_files(spark, paths, kind) for kind, paths in formats.items()]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        if any(kind in _TEXT_FORMATS for kind in formats):
            mapped = typed(rows, lattice, on_error)
            rows, rejects[name] = mapped.rows, mapped.rejects
        for kind in [k for k in formats if k in _SURPLUS_ROWS]:
            surplus = _surplus_rejects(_SURPLUS_ROWS[kind](spark, formats[kind]), rejects[name])
            rejects[name] = rejects[name].unionByName(surplus, allowMissingColumns=True)
        tables[name] = rows
        every = [_EVERY_ROW.get(k, partial(read_files, file_format=k))(spark, p) for k, p in formats.items()]
        unfiltered[name] = reduce(DataFrame.unionAll, [df.select(F.lit(1).alias("row")) for df in every])
    return tables, rejects, unfiltered


def _surplus_rejects(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Rows with more cells than their header, in the form of other rejects.

    The first fault holds the cells of the header and the first filled one beyond it, the second the whole row.
    """
    read = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != RECORD]))
    faults = [
        F.struct(F.lit(SURPLUS).alias("column"), F.lit(rule).alias("rule"), value.alias("value"))
        for rule, value in (("more cells than the header", read), ("whole row", F.col(RECORD)))
    ]
    cells = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in like.schema if f.name in rows.columns]
    return rows.select(*cells, F.array(*faults).cast(FAULT_TYPE).alias(FAULTS))


def plan_files(spark: SparkSession, path: str, fresh: bool = False, **options) -> DataFrame:
    """What a load of files would do (K10); neither tables nor rows are written."""
    return dry_run(spark, file_tables(spark, path, **options)[0], fresh=fresh)


def load_files(
    spark: SparkSession,
    path: str,
    target_path: str,
    specs: Mapping[str, TableSpec] | None = None,
    options: LoadOptions = LoadOptions(),
    history: RunHistory | None = None,
    run_id: str | None = None,
    sink: ExternalTarget | None = None,
    **reading,
) -> LoadResult:
    """Load every supported file of a folder into a table of its name, in ``sink`` if there is one."""
    tables, rejects, unfiltered = _read_tables(spark, path, **reading)
    return load_tables(
        spark, tables, target_path, specs, (), options, history,
        source_name=path, run_id=run_id, refused=rejects, unfiltered=unfiltered, sink=sink,
    )
