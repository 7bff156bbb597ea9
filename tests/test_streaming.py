import time

import pytest
from pyspark.sql import functions as F

from drayline.sinks.snapshot import SnapshotTable
from drayline.streaming.ingest import RowCounter, file_stream, ingest, ingest_upserts

SCHEMA = "id long, seq long, v string"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def test_files_are_taken_once(spark, folder):
    target = SnapshotTable(spark, str(folder / "t"))

    counter = RowCounter()
    spark.streams.addListener(counter)

    def run():
        stream = file_stream(spark, str(folder / "in"), SCHEMA, max_files=1)
        ingest(stream, target, str(folder / "c"), "run").awaitTermination()
        return target.read().count(), target.state().commit_no

    arrive(spark, folder, [(1, 1, "a")])
    arrive(spark, folder, [(2, 1, "b")])
    first = run()
    assert first[0] == 2
    assert run() == first  # nothing new, no batch
    arrive(spark, folder, [(3, 1, "c")])
    assert run() == (3, first[1] + 1)
    for _ in range(50):  # listeners are told a little later
        if counter.rows.get("run") == 3:
            break
        time.sleep(0.2)
    spark.streams.removeListener(counter)
    assert counter.rows["run"] == 3


def test_a_batch_that_dies_is_repeated(spark, folder):
    target = SnapshotTable(spark, str(folder / "t"))
    arrive(spark, folder, [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")])

    def run(shape=None):
        stream = file_stream(spark, str(folder / "in"), SCHEMA)
        ingest_upserts(stream, target, str(folder / "c"), "run", ["id"], "seq", 4, shape).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run(lambda b: b.withColumn("v", F.raise_error(F.lit("lost")).cast("string")))
    run()
    assert sorted(tuple(r) for r in target.read().collect()) == [(1, 2, "b"), (2, 1, "c")]


def test_a_batch_that_dies_after_its_commit_is_not_doubled(spark, folder):
    target = SnapshotTable(spark, str(folder / "t"))
    arrive(spark, folder, [(1, 1, "a")])

    class Dying(SnapshotTable):
        def append(self, *args, **kwargs):
            super().append(*args, **kwargs)
            raise RuntimeError("lost after commit")

    def run(table):
        stream = file_stream(spark, str(folder / "in"), SCHEMA)
        ingest(stream, table, str(folder / "c"), "run").awaitTermination()

    with pytest.raises(Exception, match="lost after commit"):
        run(Dying(spark, target.path))
    assert target.read().count() == 1
    run(target)
    assert target.read().count() == 1
