"""Incremental ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from drayline.operators.mapping import apply_spec
from drayline.plans.spec import ColumnMapping, TableSpec
from drayline.session import shared_dir
from drayline.sinks.snapshot import SnapshotTable
from drayline.streaming.ingest import file_stream, ingest, ingest_upserts
from registry import query, table

FILES = 4


def _arriving(spark, sf_dir, columns: list[str]) -> tuple[str, object]:
    """Events in several files, those with higher ids arriving later."""
    path = shared_dir(spark, "arriving")
    events = table(spark, sf_dir, "events").select(*columns)
    for step in range(2):
        half = events.where(F.col("event_id") % 2 == step)
        half.repartition(FILES).write.mode("append").parquet(path)
    return path, events.schema


@query("stream_ingest", "select event_id, ts, user_id, upper(event_type) as event_type, value, props from events")
def stream_ingest(spark, sf_dir):
    """New files cleaned and appended; the second start finds nothing to do."""
    path, schema = _arriving(spark, sf_dir, ["event_id", "ts", "user_id", "event_type", "value", "props"])
    target = SnapshotTable(spark, shared_dir(spark, "ingested"))
    checkpoint = shared_dir(spark, "offsets")
    spec = TableSpec("events", [ColumnMapping("event_type", action="transform", rules="uppercase")])
    for _ in range(2):
        stream = file_stream(spark, path, schema, max_files=3)
        ingest(stream, target, checkpoint, "ingest", lambda b: apply_spec(b, spec).rows).awaitTermination()
    return target.read()


@query(
    "stream_upsert",
    "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id",
)
def stream_upsert(spark, sf_dir):
    """The newest event of each user, kept up to date file by file.

    Files are made in the order of the event ids, so a later batch is newer.
    """
    path = shared_dir(spark, "changes")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    bounds = events.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    step = (bounds.hi - bounds.lo) // FILES + 1
    target = SnapshotTable(spark, shared_dir(spark, "current"))
    checkpoint = shared_dir(spark, "offsets")
    for i in range(FILES):
        low = bounds.lo + i * step
        arrived = events.where((F.col("event_id") >= low) & (F.col("event_id") < low + step))
        arrived.write.mode("append").parquet(path)
        stream = file_stream(spark, path, events.schema)
        ingest_upserts(
            stream, target, checkpoint, "changes", ["user_id"], "event_id", buckets=8
        ).awaitTermination()
    return target.read()


_LATEST = "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id"


@query(
    "stream_upsert_late",
    f"select 1 as files, * from ({_LATEST}) union all select 4, * from ({_LATEST})",
)
def stream_upsert_late(spark, sf_dir):
    """Files arrive newest first: older events don't replace newer ones, however files fall into batches."""
    path = shared_dir(spark, "late")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    bounds = events.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    step = (bounds.hi - bounds.lo) // FILES + 1
    for i in reversed(range(FILES)):
        low = bounds.lo + i * step
        part = events.where((F.col("event_id") >= low) & (F.col("event_id") < low + step))
        part.coalesce(1).write.mode("append").parquet(path)
    results = []
    for files in (1, 4):
        target = SnapshotTable(spark, shared_dir(spark, "current"))
        stream = file_stream(spark, path, events.schema, max_files=files)
        ingest_upserts(
            stream, target, shared_dir(spark, "offsets"), f"late-{files}", ["user_id"], "event_id", buckets=8
        ).awaitTermination()
        results.append(target.read().select(F.lit(files).alias("files"), "user_id", "event_id", "event_type"))
    return results[0].unionByName(results[1])
