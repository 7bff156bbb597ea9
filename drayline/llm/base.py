"""What the operators share: words, staged tables, files in the shared folder, Arrow columns."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable
from urllib.parse import urlparse
from urllib.request import url2pathname

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.session import shared_dir

#: A word is a run of characters other than the six ASCII blanks; bytes.split() cuts at the same six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, short lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def column_udf(function: Callable[[pa.Array], pa.Array], returns: str) -> Callable[..., Column]:
    """An Arrow UDF; marked so that a filter on its result doesn't make Spark run it twice."""
    return F.arrow_udf(function, returns).asNondeterministic()


def struct_array(columns: dict[str, pa.Array]) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, NULL as empty."""
    return [x or "" for x in column.to_pylist()]


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path or URI of the shared folder, and the path in it."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), url2pathname(parts.path) if parts.scheme else path
    return fs.FileSystem.from_uri(path)


def write_file(folder: str, name: str, chunks) -> int:
    """Write byte chunks to a new file; its size.

    A name is used by one task attempt only, and a file counts only when the manifest names it:
    what a lost executor leaves behind is never read.
    """
    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)
    size = 0
    with system.open_output_stream(posixpath.join(root, name), compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return size


class RangeReader:
    """Reads byte ranges of files in one folder, keeping the last file open."""

    def __init__(self, folder: str):
        self.system, self.root = filesystem(folder)
        self.name, self.file = None, None

    def size(self, name: str) -> int:
        self._open(name)
        return self.file.size()

    def read(self, name: str, offset: int, length: int) -> bytes:
        self._open(name)
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"{name}: {length} bytes at {offset} wanted, {len(data)} there")
        return data

    def _open(self, name: str) -> None:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.system.open_input_file(posixpath.join(self.root, name))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name = self.file = None


def attempt_name(prefix: str) -> str:
    """A file name no other task attempt uses."""
    return f"{prefix}-{os.urandom(8).hex()}"


def range_bounds(df: DataFrame, column: str, parts: int) -> list:
    """At most ``parts - 1`` ascending split points of a column, from its approximate quantiles."""
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, cuts, 10 * parts).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def part_number(column: Column, bounds: list) -> Column:
    """How many bounds lie at or below the value; 0 for NULL."""
    if not bounds:
        return F.lit(0)
    kind = "array<double>" if isinstance(bounds[0], float) else "array<bigint>"
    below = F.expr(f"cast(array({','.join(map(str, bounds))}) as {kind})")
    return F.when(column.isNull(), F.lit(0)).otherwise(F.size(F.filter(below, lambda b: b <= column)))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
