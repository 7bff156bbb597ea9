"""Records of files that line ends don't part, cut by many tasks.

A file is read in the blocks Spark deals it out in. What a stretch of it does to the reader's state (is it inside
a quoted cell or a string, how many brackets are open) is a small function of the state it starts in:

    inside0, inside1: the state behind it if it starts outside (0) or inside (1)
    depth0, depth1: by how much it changes the depth then

A first scan composes that function per block, a prefix scan over a file's blocks gives the state each block
really starts in, and a second scan cuts the records. Only a record that crosses a block's border is put
together from fragments in a shuffle; all others stay in the task that read them. A file is never one value.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUMMARY = "path string, block long, inside0 int, inside1 int, depth0 long, depth1 long, size long, lead string"
#: part 0: a whole record; 1: the start of one that goes on in the next block; 2: what goes on from the block
#: before; 3: like 1, but of something that is not a record.
PIECES = "path string, block long, line long, part int, first boolean, record string"
WHOLE, START, REST, OTHER = range(4)


def block_states(summaries: DataFrame) -> DataFrame:
    """The summaries with inside and depth, the state each block starts in.

    A function that ends alike from both states hides all before it; of the others only how often they swap the
    states counts. Both follow from running sums over a file's blocks (one small row each).
    """
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swaps = ((F.col("inside0") == 1) & (F.col("inside1") == 0)).cast("int")
    counted = summaries.withColumn("swaps", F.sum(swaps).over(so_far))
    fixed = F.when(F.col("inside0") == F.col("inside1"), F.struct("inside0", "swaps"))
    last = counted.withColumn("fixed", F.last(fixed, ignorenulls=True).over(before)).withColumn(
        "swapped", F.coalesce(F.lag("swaps").over(order), F.lit(0))
    )
    inside = (F.coalesce(F.col("fixed.inside0"), F.lit(0)) + F.col("swapped") - F.coalesce(F.col("fixed.swaps"), F.lit(0))) % 2
    known = last.withColumn("inside", inside.cast("int"))
    change = F.when(F.col("inside") == 1, F.col("depth1")).otherwise(F.col("depth0"))
    depth = F.coalesce(F.sum(change).over(before), F.lit(0)).cast("long")
    return known.select(*summaries.columns, "inside", depth.alias("depth"))


def put_together(fragments: DataFrame) -> DataFrame:
    """(path, block, line, first, record) of the records that cross blocks.

    A fragment belongs to the last start before it in its file.
    """
    order = Window.partitionBy("path").orderBy("block", F.when(F.col("part") == REST, 0).otherwise(1))
    begun = F.when(F.col("part") != REST, F.struct("block", "line", "first", (F.col("part") == START).alias("real")))
    owned = fragments.withColumn("owner", F.last(begun, ignorenulls=True).over(order)).where("owner.real")
    texts = F.sort_array(F.collect_list(F.struct("block", F.col("part") == REST, "record")))
    return (
        owned.groupBy("path", "owner.block", "owner.line", "owner.first")
        .agg(F.array_join(F.transform(texts, lambda x: x["record"]), "").alias("record"))
        .select("path", "block", "line", "first", "record")
    )


def _runs(path: pa.Array, block: pa.Array) -> Iterator[tuple[str, int, int, int]]:
    """(path, block, from, to) of the runs of equal blocks in a batch."""
    places, blocks = path.dictionary_encode(), block.to_numpy(zero_copy_only=False)
    codes = places.indices.to_numpy(zero_copy_only=False)
    edges = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
        if end > start:
            yield places.dictionary[int(codes[start])].as_py(), int(blocks[start]), start, end


@dataclass
class Summary:
    """The function of a block as far as it was read."""

    path: str
    block: int
    inside: list[int] = field(default_factory=lambda: [0, 1])
    depth: list[int] = field(default_factory=lambda: [0, 0])
    size: int = 0
    lead: str = ""

    def add(self, inside: tuple[int, int], depth: tuple[int, int], size: int, lead: str) -> None:
        self.depth = [self.depth[s] + depth[self.inside[s]] for s in (0, 1)]
        self.inside = [inside[self.inside[s]] for s in (0, 1)]
        self.size += size
        self.lead = self.lead or lead


Fold = Callable[[pa.RecordBatch], tuple[tuple[int, int], tuple[int, int], int, str]]


def summarised(rows: DataFrame, fold: Fold) -> DataFrame:
    """One row per block of ``rows`` (path, block, ... in the order of the file), by the function of its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Summary | None = None
        for batch in batches:
            done: list[Summary] = []
            for path, block, start, end in _runs(batch.column("path"), batch.column("block")):
                if last is None or (last.path, last.block) != (path, block):
                    if last is not None:
                        done.append(last)
                    last = Summary(path, block)
                last.add(*fold(batch.slice(start, end - start)))
            if done:
                yield as_batch(done)
        if last is not None:
            yield as_batch([last])

    def as_batch(found: list[Summary]) -> pa.RecordBatch:
        columns = {
            "path": [s.path for s in found], "block": [s.block for s in found],
            "inside0": pa.array([s.inside[0] for s in found], pa.int32()), "inside1": pa.array([s.inside[1] for s in found], pa.int32()),
            "depth0": [s.depth[0] for s in found], "depth1": [s.depth[1] for s in found],
            "size": [s.size for s in found], "lead": [s.lead for s in found],
        }
        return pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, SUMMARY)


class Cutter:
    """Cuts the records of one block; batches come in the order of the file."""

    def begin(self, path: str, block: int, inside: int, depth: int, base: int) -> None:
        raise NotImplementedError

    def cut(self, batch: pa.RecordBatch) -> tuple[np.ndarray | None, list[tuple]]:
        """Which rows are whole records as they are, and other rows of PIECES without path and block."""
        raise NotImplementedError

    def end(self) -> Iterator[tuple]:
        raise NotImplementedError


def records_of(rows: DataFrame, states: DataFrame, make: Callable[[], Cutter]) -> DataFrame:
    """(path, block, line, first, record) of rows (path, block, line, value, ...), given the blocks' states and bases.

    Two scans: one for the records inside blocks, one of the blocks whose borders are inside a record.
    """
    starts_open = (F.col("inside") == 1) | (F.col("depth") > F.col("base"))
    order = Window.partitionBy("path").orderBy("block")
    marked = states.withColumn("crossing", starts_open | F.coalesce(F.lead(starts_open).over(order), F.lit(True)))
    whole = _pieces(rows, marked, make, WHOLE)
    fragments = _pieces(rows, marked.where("crossing"), make, None)
    return whole.drop("part").unionByName(put_together(fragments))


def _pieces(rows: DataFrame, states: DataFrame, make: Callable[[], Cutter], part: int | None) -> DataFrame:
    """PIECES of the rows in the blocks of ``states``: the whole ones, or all others."""
    placed = rows.join(states.select("path", "block", "inside", "depth", "base"), ["path", "block"], "inner" if part is None else "left")
    # a join by shuffle loses the order of the file; after one by broadcast there is little to sort
    ordered = placed.sortWithinPartitions("path", "block", "line")
    names = ["path", "block", "line", "part", "first", "record"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    def as_batch(found: list[tuple]) -> pa.RecordBatch:
        kept = [f for f in found if (f[3] == WHOLE) == (part == WHOLE)]
        columns = zip(*kept, strict=True) if kept else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def as_they_are(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        columns = [
            batch.column("path"), batch.column("block"), batch.column("line"), pa.array(np.full(n, WHOLE, np.int32)),
            pa.array(np.zeros(n, bool)), batch.column("value"),
        ]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, at = make(), None
        for batch in batches:
            found: list[tuple] = []
            for path, block, start, end in _runs(batch.column("path"), batch.column("block")):
                some = batch.slice(start, end - start)
                if at != (path, block):
                    if at is not None:
                        found += [(*at, *piece) for piece in cutter.end()]
                    at = (path, block)
                    state = [some.column(c)[0].as_py() for c in ("inside", "depth", "base")]
                    if None in state:
                        raise ValueError(f"{path} was dealt out in other blocks the second time")
                    cutter.begin(path, block, *state)
                plain, pieces = cutter.cut(some)
                if plain is not None and part == WHOLE:
                    yield as_they_are(some.filter(pa.array(plain)))
                found += [(path, block, *piece) for piece in pieces]
            yield as_batch(found)
        if at is not None:
            yield as_batch([(*at, *piece) for piece in cutter.end()])

    return ordered.mapInArrow(run, PIECES)


# ---------------------------------------------------------------------------
# Lines, and cells that span them
# ---------------------------------------------------------------------------


def opens_cell(line: Column, separator: str) -> Column:
    """Whether a line that starts outside quotes ends inside a quoted cell.

    Only a quote sign at the start of a cell opens; two inside stand for one; what follows a closing one up to
    the separator is plain text, as is a quote sign further on in a cell.
    """
    return F.contains(line, F.lit('"')) & F.regexp_like(line, F.lit(f'^{_cells(separator)}"(?:[^"]++|"")*+\\z'))


def stays_inside(line: Column, separator: str) -> Column:
    """Whether a line that starts inside a quoted cell ends inside one."""
    rest = f'(?:"{_plain(separator)}{re.escape(separator)}{_cells(separator)}"(?:[^"]++|"")*+)?+'
    return ~F.contains(line, F.lit('"')) | F.regexp_like(line, F.lit(f'^(?:[^"]++|"")*+{rest}\\z'))


def _plain(separator: str) -> str:
    """What is left of a cell up to its separator; lines hold no line ends."""
    if len(separator) == 1:
        return f"[^{re.escape(separator)}]*+"
    return rf"(?:(?!{re.escape(separator)})[\s\S])*+"


def _cells(separator: str) -> str:
    """All cells of a line that are closed and followed by a separator."""
    plain = _plain(separator)
    return f'(?:(?:"(?:[^"]++|"")*+"{plain}|(?!"){plain}){re.escape(separator)})*+'


def csv_lines(spark: SparkSession, paths: list[str], separator: str, utf8: bool) -> DataFrame:
    """(path, block, line, value, opens, stays) of the lines of delimited files."""
    value = F.col("value") if utf8 else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        value.alias("value"),
    )
    return lines.select(
        "*", opens_cell(F.col("value"), separator).alias("opens"), stays_inside(F.col("value"), separator).alias("stays")
    )


def _bits(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(bool)


def _states_after(opens: np.ndarray, stays: np.ndarray, start: int) -> np.ndarray:
    """Inside a cell or not behind each line, from the state before the first."""
    at = np.arange(len(opens))
    fixed = opens == stays
    swaps = np.cumsum(opens & ~stays)
    last = np.maximum.accumulate(np.where(fixed, at, -1))
    known = last >= 0
    base = np.where(known, opens[last], start)
    return (base + swaps - np.where(known, swaps[last], 0)) % 2


def _fold_lines(batch: pa.RecordBatch) -> tuple[tuple[int, int], tuple[int, int], int, str]:
    opens, stays = _bits(batch, "opens"), _bits(batch, "stays")
    after = tuple(int(_states_after(opens, stays, s)[-1]) for s in (0, 1))
    return after, (0, 0), batch.num_rows, ""


class LineCutter(Cutter):
    """Joins lines to records by line ends; the first record of a file that isn't empty is its header."""

    def begin(self, path: str, block: int, inside: int, depth: int, base: int) -> None:
        self.inside, self.rest = inside, bool(inside)
        self.header = block == 0  # still to come
        self.open: list[str] = []
        self.line = 0

    def cut(self, batch: pa.RecordBatch) -> tuple[np.ndarray | None, list[tuple]]:
        after = _states_after(_bits(batch, "opens"), _bits(batch, "stays"), self.inside)
        alone = (np.concatenate([[self.inside], after[:-1]]) == 0) & (after == 0)
        self.inside = int(after[-1])
        if self.header:  # until the header is found each line is looked at
            alone[:] = False
        alone &= pc.greater(pc.binary_length(batch.column("value")), 0).to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~alone)
        some = batch.take(pa.array(others))
        found: list[tuple] = []
        columns = some.column("value").to_pylist(), some.column("line").to_pylist(), after[others].tolist()
        for value, line, goes_on in zip(*columns, strict=True):
            if not self.open:
                self.line = line
                if not goes_on and not self.rest:  # an empty line, or one looked at for the header
                    if value:
                        found.append((line, WHOLE, self.header, value))
                        self.header = False
                    continue
            self.open.append(value)
            if not goes_on:
                found += self._close(REST if self.rest else WHOLE, "")
                self.rest = False
        return alone, found

    def _close(self, part: int, end: str) -> Iterator[tuple]:
        first = self.header and part != REST
        if first:
            self.header = False
        yield self.line, part, first, "\n".join(self.open) + end
        self.open = []

    def end(self) -> Iterator[tuple]:
        if self.open:  # the line end between this block and the next is part of the cell
            yield from self._close(REST if self.rest else START, "\n")


def csv_records(spark: SparkSession, paths: list[str], separator: str, utf8: bool) -> DataFrame:
    """(path, block, line, first, record): the records of delimited files, whose cells may span lines.

    ``first`` marks headers. Line ends inside cells come out as line feeds.
    """
    lines = csv_lines(spark, paths, separator, utf8)
    states = block_states(summarised(lines.select("path", "block", "opens", "stays"), _fold_lines))
    records = records_of(lines, states.withColumn("base", F.lit(0)), LineCutter)
    # the last record of a file may be open at its end
    return records.withColumn("record", F.rtrim("record", F.lit("\n"))).where(F.col("record") != "")


# ---------------------------------------------------------------------------
# JSON documents
# ---------------------------------------------------------------------------

CLOSING = "}"


def json_chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, block, line, value, file_size) of JSON files, parted behind closing braces, which are left out."""
    return spark.read.option("lineSep", CLOSING).text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
        F.col("_metadata.file_size").alias("file_size"),
    )


@dataclass
class Structure:
    """Bytes of a stretch, and where its structure is."""

    data: np.ndarray
    parity: np.ndarray  # quote signs so far, odd or even
    places: np.ndarray  # of brackets and braces
    step: np.ndarray  # 1 where they open, -1 where they close

    def outside(self, inside: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and steps that are not in strings, from the state before."""
        real = self.parity[self.places] == inside
        return self.places[real], self.step[real]


def structure_of(batch: pa.RecordBatch) -> Structure:
    raw = CLOSING.join([*batch.column("value").to_pylist(), ""]).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    quote = data == 34
    back = data == 92
    if back.any():  # a sign behind an odd run of backslashes is escaped
        at = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(back, -1, at))
        run = np.concatenate([[0], (at - plain)[:-1]])
        quote &= run % 2 == 0
    parity = (np.cumsum(quote) & 1).astype(np.uint8)
    opening, closing = (data == 123) | (data == 91), (data == 125) | (data == 93)
    places = np.flatnonzero(opening | closing)
    return Structure(data, parity, places, np.where(opening[places], 1, -1))


def _fold_chunks(batch: pa.RecordBatch) -> tuple[tuple[int, int], tuple[int, int], int, str]:
    found = structure_of(batch)
    odd = int(found.parity[-1]) if len(found.parity) else 0
    depth = tuple(int(found.outside(s)[1].sum()) for s in (0, 1))
    lead = found.data[:4096].tobytes().decode("utf-8", "replace").lstrip("﻿ \t\r\n")[:1]
    return (odd, 1 - odd), depth, len(found.data), lead


class ObjectCutter(Cutter):
    """Cuts objects that open at a depth of ``base``: 1 in an array, 0 where the document is an object."""

    def begin(self, path: str, block: int, inside: int, depth: int, base: int) -> None:
        self.inside, self.depth, self.base = inside, depth, base
        self.rest = depth > base  # what is open began in an earlier block
        self.is_object = True
        self.open: list[bytes] = []
        self.line = 0

    def cut(self, batch: pa.RecordBatch) -> tuple[np.ndarray | None, list[tuple]]:
        pieces: list[tuple] = []
        found = structure_of(batch)
        places, step = found.outside(self.inside)
        depth = self.depth + np.cumsum(step)
        edges = ((step == 1) & (depth == self.base + 1)) | ((step == -1) & (depth == self.base))
        raw, start = found.data.tobytes(), 0
        pending = self.depth > self.base
        for place, opening in zip(places[edges].tolist(), (step[edges] == 1).tolist(), strict=True):
            if opening:
                start, pending, self.is_object = place, True, raw[place] == 123
                continue
            if pending and raw[place] == 125 and (self.rest or self.is_object):
                self.open.append(raw[start : place + 1])
                pieces += self._close(REST if self.rest else WHOLE)
            self.open, pending, self.rest = [], False, False
        if pending:
            self.open.append(raw[start:])
        if len(found.parity):
            self.inside ^= int(found.parity[-1])
        if len(depth):
            self.depth = int(depth[-1])
        return None, pieces

    def _close(self, part: int) -> Iterator[tuple]:
        yield self.line, part, False, b"".join(self.open).decode("utf-8", "surrogatepass")
        self.open = []
        self.line += 1

    def end(self) -> Iterator[tuple]:
        if self.open and (self.rest or self.is_object):
            yield from self._close(REST if self.rest else START)
        elif self.open:
            yield self.line, OTHER, False, ""


def json_elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, block, line, record): the objects of JSON documents, as text.

    A document is an array, whose other elements are left out, or a single object. One that is neither, or whose
    brackets or strings stay open, raises.
    """
    chunks = json_chunks(spark, paths)
    summaries = summarised(chunks.select("path", "block", "value"), _fold_chunks)
    # what the closing brace put behind a file's last chunk stands for: one in the file, or none
    own = Window.partitionBy("path")
    states = block_states(summaries).join(chunks.groupBy("path").agg(F.max("file_size").alias("file_size")), "path")
    ends_inside = F.when(F.col("inside") == 1, F.col("inside1")).otherwise(F.col("inside0"))
    ends_at = F.col("depth") + F.when(F.col("inside") == 1, F.col("depth1")).otherwise(F.col("depth0"))
    # (the reader leaves out a byte order mark of three bytes)
    missing = (F.sum("size").over(own) - F.col("file_size")).isin(1, -2).cast("int")
    left = F.max_by(ends_at, "block").over(own) + missing
    root = F.min_by("lead", F.when(F.col("lead") != "", F.col("block"))).over(own)
    sound = root.isin("[", "{") & (left == 0) & (F.max_by(ends_inside, "block").over(own) == 0)
    message = F.concat(F.lit("not a JSON array or object: "), F.col("path"))
    base = F.when(~F.coalesce("sound", F.lit(False)), F.raise_error(message).cast("int")).when(F.col("root") == "[", 1).otherwise(0)
    checked = states.withColumn("root", root).withColumn("sound", sound).withColumn("base", base)
    return records_of(chunks.drop("file_size"), checked, ObjectCutter).drop("first")
