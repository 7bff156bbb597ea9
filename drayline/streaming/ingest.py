"""Incremental ingestion of files into snapshot tables.

The file source remembers what it has read in its checkpoint, so a rerun
takes new files only. Every micro-batch is committed under its run and batch
number; a batch that is repeated after a crash changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from drayline.sinks.snapshot import SnapshotTable

Shape = Callable[[DataFrame], DataFrame]


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    file_format: str = "parquet",
    max_files: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """New files of a folder as a stream; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).options(**(options or {}))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(file_format).load(path)


def _run(
    stream: DataFrame,
    target: SnapshotTable,
    checkpoint: str,
    run_id: str,
    put: Callable[[DataFrame, int], None],
    every: str | None,
) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).queryName(run_id)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).foreachBatch(put).start()


def ingest(
    stream: DataFrame,
    target: SnapshotTable,
    checkpoint: str,
    run_id: str,
    shape: Shape | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Append every new file's rows (C8); ``shape`` cleans a batch first.

    Without ``every`` the query takes what is there and stops. Stopping and
    starting it again is how a load is paused: it goes on with the next file.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = shape(batch) if shape else batch
        if not target.exists():
            target.create(rows.schema)
        target.append(rows, run_id=run_id, batch_id=number)

    return _run(stream, target, checkpoint, run_id, put, every)


def ingest_upserts(
    stream: DataFrame,
    target: SnapshotTable,
    checkpoint: str,
    run_id: str,
    keys: Sequence[str],
    sequence: str,
    buckets: int,
    shape: Shape | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Merge every new file's rows by key (C9); the last by ``sequence`` wins,
    however the files fall into batches. Among equals a later batch wins."""

    def put(batch: DataFrame, number: int) -> None:
        rows = shape(batch) if shape else batch
        if not target.exists():
            target.create(rows.schema, keys, buckets)
        target.upsert(rows, sequence=sequence, run_id=run_id, batch_id=number)

    return _run(stream, target, checkpoint, run_id, put, every)


class RowCounter(StreamingQueryListener):
    """Rows taken so far by each named query, live.

    Register it with ``spark.streams.addListener``.
    """

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
