"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# What every job here relies on. UTC keeps date text independent of the
# machine; ANSI makes a bad cast an error instead of a silent NULL.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.scheduler.mode": "FAIR",
    # A JSON object may repeat a key; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(
    app_name: str = "drayline",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the defaults above; ``extra`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path every executor can reach.

    It lies under the folder the cluster names in ``spark.checkpoint.dir``.
    Only a local-mode session without that setting gets a temporary folder:
    on a cluster such a folder would be private to one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="drayline-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any Hadoop file system; empty if it is missing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(folder))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def rename_folder(spark: SparkSession, source: str, target: str) -> bool:
    """Give a folder a new name, unless one with that name is there: False then.

    On file systems with an atomic rename (HDFS, local disks) only one of
    several callers succeeds.
    """
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    system = new.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(new.getParent())
    if system.exists(new) or not system.rename(old, new):
        return False
    # A rename onto a folder that came up meanwhile puts the old one inside it.
    nested = spark._jvm.org.apache.hadoop.fs.Path(new, old.getName())
    return not system.exists(nested)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder this library has made with ``shared_dir`` and read for the last time."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
