"""Database targets (K3, K6, K9).

Rows are written by Spark's JDBC writer. A merge goes through a staging table
that Spark fills in parallel once, followed by one statement in the target's
dialect; running that statement is left to a callable of the user's, since it
needs a connection and no data work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from drayline.plans.dialects import MYSQL, POSTGRESQL, SQLITE
from drayline.sources.jdbc import Database, quote, quote_column

BATCH_ROWS = 10_000


def write_table(
    df: DataFrame,
    database: Database,
    table: str,
    mode: str = "append",
    connections: int | None = None,
    batch_rows: int = BATCH_ROWS,
) -> None:
    """Insert rows in batches; ``overwrite`` empties the table but keeps its definition.

    ``connections`` bounds how many tasks write at once.
    """
    options = {k: v for k, v in database.reader_options().items() if k != "fetchsize"}
    writer = (
        df.write.format("jdbc")
        .options(**options)
        .option("dbtable", quote(table, database.dialect))
        .option("batchsize", str(batch_rows))
        .option("truncate", "true")
    )
    if connections:
        writer = writer.option("numPartitions", str(connections))
    writer.mode(mode).save()


def merge_statement(
    table: str, staging: str, columns: Sequence[str], keys: Sequence[str], dialect: str
) -> str:
    """One statement that merges a staging table into its target.

    Non-key columns are updated; a table of keys only gets missing rows.
    """
    if not keys:
        raise ValueError("a merge needs key columns")
    names = {c: quote_column(c, dialect) for c in columns}
    listed = ", ".join(names.values())
    others = [c for c in columns if c not in keys]
    target, source = quote(table, dialect), quote(staging, dialect)

    if dialect in (POSTGRESQL, SQLITE):
        action = "nothing"
        if others:
            action = "update set " + ", ".join(f"{names[c]} = excluded.{names[c]}" for c in others)
        # SQLite needs a WHERE before ON CONFLICT to tell it from a join.
        where = " where true" if dialect == SQLITE else ""
        conflict = ", ".join(names[k] for k in keys)
        return (
            f"insert into {target} ({listed}) select {listed} from {source}{where} "
            f"on conflict ({conflict}) do {action}"
        )
    if dialect == MYSQL:
        if not others:
            return f"insert ignore into {target} ({listed}) select {listed} from {source}"
        updates = ", ".join(f"{names[c]} = values({names[c]})" for c in others)
        return (
            f"insert into {target} ({listed}) select {listed} from {source} "
            f"on duplicate key update {updates}"
        )
    match = " and ".join(f"t.{names[k]} = s.{names[k]}" for k in keys)
    statement = f"merge into {target} as t using {source} as s on {match}"
    if others:
        statement += " when matched then update set " + ", ".join(f"t.{names[c]} = s.{names[c]}" for c in others)
    values = ", ".join(f"s.{n}" for n in names.values())
    return statement + f" when not matched then insert ({listed}) values ({values});"


def merge_table(
    df: DataFrame,
    database: Database,
    table: str,
    keys: Sequence[str],
    execute: Callable[[str], object],
    connections: int | None = None,
) -> None:
    """Fill a staging table with Spark, then merge it once (K6).

    Keys must be unique in ``df`` (see ``last_per_key``).
    """
    staging = f"{table.rsplit('.', 1)[-1]}_staging"
    write_table(df, database, staging, mode="overwrite", connections=connections)
    execute(merge_statement(table, staging, df.columns, keys, database.dialect))
