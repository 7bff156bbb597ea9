"""Parquet tables with overwrite, append and upsert by key (K1-K5, K7, K8).

A keyed table is split into directories by a hash of its key. Every write puts
its files into a new part and then commits one manifest row that names the live
parts in order; a write that dies leaves the table as it was. One writer at a time.

An upsert of few rows is a part of its own that readers merge in: it costs bytes
for its own rows only. A larger one rewrites the buckets its rows fall in, which
are then dead in the parts before. Merged parts are folded into the rows when they
have become many. A table's number of buckets doubles as it grows; a part keeps the
number it was written with, and gets the present one when it is rewritten.

    <path>/data/table_part=<token>/table_bucket=<n>/*.parquet

Small buckets share a folder: that of bucket b among f folders is b % f, and its rows are told by their key.
    <path>/manifest/version=<n>/*.parquet
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import astuple, dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from drayline.session import child_names, drop_folder, folder_bytes, rename_folder, shared_dir

BUCKET, PART = "table_bucket", "table_part"
_FOLDER = "table_folder"  # of a row while it is written
BUCKET_BYTES = 256 * 1024 * 1024
# Buckets smaller than this share folders, so that files follow the bytes and not the buckets.
FOLDER_BYTES = 16 * 1024 * 1024
# Among this many folders at most, a task that reads 128 MB still gives each of them that much: many rows are then
# written by the tasks that have them, without a shuffle, whose files are twice as large as the source's.
DIRECT_FOLDERS = 8
UNKNOWN_BYTES = 2**62
# Beyond this many buckets, buckets grow instead. A shuffle by bucket has one
# partition per bucket, and the manifest one entry.
MAX_BUCKETS = 20_000
# More parts of a level than this are merged into one after an append, and more
# merged parts than MAX_MERGES are folded into the rows.
MAX_PARTS = 64
MAX_MERGES = 16
# An upsert is merged when it is read if the buckets it falls in hold this many
# times its rows or more; the folding of merged parts starts at the same share.
MERGE_SHARE = 8
# Keys of an upsert source up to this many bytes are broadcast; beyond it the
# old and new rows are shuffled once, by bucket.
BROADCAST_KEY_BYTES = 32 * 1024 * 1024

MANIFEST_SCHEMA = (
    "commit_no long, kind string, run_id string, batch_id long, batches map<string,long>, "
    "schema string, keys array<string>, buckets int, rows long, added array<int>, "
    "parts array<struct<name:string,merges:boolean,level:int,buckets:int,rows:long,size:long,filled:array<int>,dead:array<int>,folders:int>>, "
    "covers array<long>, committed_at timestamp"
)


@dataclass(frozen=True)
class Part:
    """Files of one write. ``filled`` is kept for merged parts only; ``dead`` buckets have been rewritten since."""

    name: str
    merges: bool  # its rows replace earlier ones of their keys
    level: int  # how often its rows were merged
    buckets: int
    rows: int
    size: int  # bytes
    filled: tuple[int, ...]
    dead: tuple[int, ...] = ()
    folders: int | None = None  # fewer than buckets when these share folders

    def bucket_of(self, keys: Sequence[str]) -> Column:
        """The bucket of a row that was read from this part."""
        return key_bucket(keys, self.buckets) if self.folders else F.col(BUCKET)


@dataclass(frozen=True)
class State:
    """What the latest manifest row says."""

    commit_no: int
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int
    parts: tuple[Part, ...]
    batches: dict[str, int]

    @property
    def size(self) -> int:
        return sum(p.size for p in self.parts)


class ConcurrentWrite(RuntimeError):
    """Another writer has committed since this one started."""


class DuplicateKeys(ValueError):
    """The rows of an upsert repeat a key and nothing tells which is last."""


def hashable(field: T.StructField) -> Column:
    """A column as it can be hashed: maps and variants, which have no hash, as JSON, keys in order."""
    column = F.col(f"`{field.name}`")
    if not _holds(field.dataType, (T.MapType, T.VariantType)):
        return column
    if isinstance(field.dataType, T.MapType) and not _holds(field.dataType.keyType, (T.MapType, T.VariantType)):
        return F.to_json(F.struct(F.sort_array(F.map_keys(column)).alias("k"), F.transform(
            F.sort_array(F.map_keys(column)), lambda k: F.element_at(column, k)).alias("v")))
    return F.to_json(F.struct(column))


def _holds(kind: T.DataType, kinds: tuple) -> bool:
    """Whether a type is, or holds, one of some types."""
    if isinstance(kind, kinds):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, kinds)
    if isinstance(kind, T.MapType):
        return _holds(kind.keyType, kinds) or _holds(kind.valueType, kinds)
    return isinstance(kind, T.StructType) and any(_holds(f.dataType, kinds) for f in kind)


def row_bucket(df: DataFrame, buckets: int) -> Column:
    """Bucket of a row of a table without a key: a hash of all its columns."""
    return F.pmod(F.xxhash64(*[hashable(f) for f in df.schema]), F.lit(buckets)).cast("int")


def key_bucket(keys: Sequence[str], buckets: int) -> Column:
    """Bucket of a row: a hash of its key, the same in every run."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def plan_bytes(df: DataFrame) -> int:
    """Bytes by the plan's estimate, ``UNKNOWN_BYTES`` or more when nothing is known; files are not listed again."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_by_size(df: DataFrame, partition_bytes: int = BUCKET_BYTES) -> int:
    """How many partitions of a given size the plan's estimate makes."""
    size = plan_bytes(df)
    if size >= UNKNOWN_BYTES:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // partition_bytes))


def bucket_count(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for a table that holds the rows of a plan."""
    return min(MAX_BUCKETS, partitions_by_size(df, bucket_bytes))


def last_per_key(
    df: DataFrame, keys: Sequence[str], sequence: str | Column, tie: Column | None = None
) -> DataFrame:
    """The last row of each key by a sequence (K7).

    An aggregation, so a key with very many rows is reduced before the
    shuffle. Equal sequence values are told apart by a hash of the row, so a
    repeated task picks the same row.
    """
    order = F.col(sequence) if isinstance(sequence, str) else sequence
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    tie = tie if tie is not None else F.xxhash64(*[hashable(df.schema[c]) for c in df.columns])
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    last = df.groupBy(*keys).agg(F.max_by(row, F.struct(order, tie)).alias("_row"))
    return last.select(
        *[F.col(f"`{c}`") if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns]
    )


def merge_rows(
    target: DataFrame, source: DataFrame, keys: Sequence[str], update: bool = True
) -> DataFrame:
    """Target with source rows merged in by key (K4, K5).

    With ``update`` a source row replaces the target row of its key, else it
    is dropped when the key exists. Source keys must be unique.
    """
    source = source.select(*target.columns)
    if update:
        kept = target.join(source.select(*keys), list(keys), "left_anti").select(*target.columns)
        return kept.unionByName(source)
    fresh = source.join(target.select(*keys), list(keys), "left_anti").select(*target.columns)
    return target.unionByName(fresh)


class SnapshotTable:
    """One table at a path."""

    def __init__(self, spark: SparkSession, path: str, bucket_bytes: int = BUCKET_BYTES, codec: str | None = None):
        self.spark = spark
        self.codec = codec or spark.conf.get("spark.sql.parquet.compression.codec")
        self.path = path.rstrip("/")
        self.bucket_bytes = bucket_bytes

    # -- reading ----------------------------------------------------------

    def manifest(self) -> DataFrame:
        """All commits; empty when there is no table yet."""
        path = f"{self.path}/manifest"
        if not child_names(self.spark, path):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(path)

    def state(self) -> State | None:
        """The newest commit. Only its own file is read, however many there are."""
        path = f"{self.path}/manifest"
        for version in reversed(child_names(self.spark, path)):
            rows = self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/{version}").collect()
            if rows:  # a commit that died left its folder empty
                row = rows[0]
                return State(
                    row.commit_no,
                    T.StructType.fromJson(json.loads(row.schema)),
                    tuple(row["keys"]),
                    row.buckets,
                    tuple(Part(*entry[:6], tuple(entry.filled), tuple(entry.dead), entry.folders) for entry in row.parts),
                    dict(row.batches),
                )
        return None

    def exists(self) -> bool:
        return self.state() is not None

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """Live rows, of the given buckets only when some are named."""
        state = self.state()
        if state is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._read(state, buckets)

    def _read(self, state: State, buckets: Iterable[int] | None = None) -> DataFrame:
        """Live rows; of buckets (in the table's present number) only when some are named."""
        wanted = None if buckets is None else set(buckets)
        rows = self._parts(state, state.parts, wanted)
        merging = [p for p in state.parts if p.merges]
        if merging:
            rows = self._merged(state, rows, merging)
        if wanted is not None and any(p.buckets < state.buckets for p in state.parts):
            rows = rows.where(key_bucket(state.keys, state.buckets).isin(sorted(wanted)))
        return rows.select(*state.schema.names)

    def _parts(self, state: State, parts: Sequence[Part], wanted: set[int] | None) -> DataFrame:
        """Rows of parts, but for dead and unwanted buckets, which are pruned as folders; with PART and BUCKET."""
        folders = T.StructType([T.StructField(PART, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        if not state.keys:
            folders = T.StructType(folders.fields[:1])
        schema = T.StructType([*state.schema.fields, *folders.fields])
        left, kept = [], []
        for part in parts:
            inside = set(range(part.buckets)) if wanted is None else {b % part.buckets for b in wanted}
            alive = inside - set(part.dead)
            if not alive:
                continue
            left.append(f"{self.path}/data/{PART}={part.name}")
            if len(alive) < part.buckets:
                few = len(alive) <= part.buckets - len(alive)
                named = part.bucket_of(state.keys).isin(sorted(alive if few else set(range(part.buckets)) - alive))
                kept.append((F.col(PART) != part.name) | (named if few else ~named))
                if part.folders:  # the rows' buckets are not folders: folders without wanted ones are pruned besides
                    kept.append((F.col(PART) != part.name) | F.col(BUCKET).isin(sorted({b % part.folders for b in alive})))
        if not left:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(schema).parquet(*left)
        return reduce(lambda df, condition: df.where(condition), kept, rows)

    def _merged(self, state: State, rows: DataFrame, merging: list[Part]) -> DataFrame:
        """Rows of parts with those of merged parts in place of earlier rows of their keys.

        Only rows in buckets that a later merged part fills are joined; what it holds is broadcast when it is small.
        """
        keys = list(state.keys)
        rest = [c for c in state.schema.names if c not in keys]
        places = {p.name: i for i, p in enumerate(state.parts)}
        row = F.struct(*[F.col(f"`{c}`") for c in rest])
        names = [p.name for p in merging]
        place = F.element_at(F.create_map(*[F.lit(x) for pair in places.items() for x in pair]), F.col(PART))
        newest = rows.where(F.col(PART).isin(names)).groupBy(*keys).agg(F.max_by(row, place).alias("_row"), F.max(place).alias("_at"))
        met = []
        for part in state.parts:
            later = [p for p in merging if places[p.name] > places[part.name]]
            filled = {b for p in later for b in _as_buckets(p.filled, p.buckets, part.buckets)} - set(part.dead)
            if filled and not part.merges:
                met.append((F.col(PART) == part.name) & part.bucket_of(state.keys).isin(sorted(filled)))
        plain = rows.where(~F.col(PART).isin(names))
        merged = newest.select(*[F.col(f"`{c}`") if c in keys else F.col("_row").getField(c).alias(c) for c in state.schema.names])
        if not met:
            return plain.select(*state.schema.names).unionByName(merged)
        joined = reduce(lambda a, b: a | b, met)
        replaced = newest.select(*keys, "_at")
        small = sum(p.size for p in merging) <= BROADCAST_KEY_BYTES
        old = plain.where(joined).withColumn("_place", place).join(F.broadcast(replaced) if small else replaced, keys, "left")
        old = old.where(F.col("_at").isNull() | (F.col("_place") > F.col("_at")))
        untouched = plain.where(~joined).select(*state.schema.names)
        return untouched.unionByName(old.select(*state.schema.names)).unionByName(merged)

    # -- writing ----------------------------------------------------------

    def create(self, schema: T.StructType, keys: Sequence[str] = (), buckets: int = 1) -> None:
        """An empty table, unless there is one already (K1)."""
        if not self.exists():
            self._commit(None, "create", schema, keys, buckets, (), 0)

    def clear(self, schema: T.StructType, keys: Sequence[str] = (), buckets: int = 1) -> None:
        """An empty table in place of the one there."""
        self._commit(self.state(), "clear", schema, keys, buckets, (), 0)

    def overwrite(
        self,
        df: DataFrame,
        keys: Sequence[str] = (),
        buckets: int | None = None,
        sequence: str | None = None,
        run_id: str | None = None,
    ) -> int:
        """Replace all rows; the old ones stay readable until the commit (K2).

        A table without a key is written as the tasks come, without a
        shuffle; one with a key is shuffled once, by bucket.
        """
        buckets = 1 if not keys else buckets or bucket_count(df)
        if sequence:
            df = last_per_key(df, keys, sequence)
        part = self._write_part(df, keys, buckets)
        self._commit(self.state(), "overwrite", df.schema, keys, buckets, (_slim(part),), part.rows, run_id, added=part.filled)
        return part.rows

    def append(
        self,
        df: DataFrame,
        run_id: str | None = None,
        batch_id: int | None = None,
        most_parts: int = MAX_PARTS,
        covers: Sequence[int] | None = None,
        expected: int | None = None,
    ) -> int:
        """Add rows (K3). A key, if there is one, is not checked. Parts beyond ``most_parts`` are merged.

        ``covers`` are the batches of a ledger that the rows are; the commit keeps them. ``expected`` is the number of
        rows, when they have been counted: many need no shuffle.
        """
        state = self._require(df)
        if batch_id is not None and state.batches.get(run_id, -1) >= batch_id:
            return 0  # a repeated batch
        df = df.select(*state.schema.names)
        buckets = self._grown(state, run_id, batch_id)
        part = self._write_part(df, state.keys, buckets, expected=expected)
        self._commit(
            state, "append", state.schema, state.keys, buckets, (*state.parts, _slim(part)), part.rows, run_id, batch_id,
            covers, part.filled,
        )
        self.compact(most_parts)
        return part.rows

    def _grown(self, state: State, run_id: str | None, batch_id: int | None) -> int:
        """The number of buckets for new parts: twice as many while they would be too large.

        The batches of a resumable load are its buckets: it keeps them.
        """
        buckets = state.buckets
        if state.keys and (run_id is None or batch_id is not None):
            while state.size > buckets * self.bucket_bytes and 2 * buckets <= MAX_BUCKETS:
                buckets *= 2
        return buckets

    def compact(self, most_parts: int = MAX_PARTS, most_merges: int = MAX_MERGES) -> int:
        """Fold merged parts when they are many, merge parts alike when there are more than ``most_parts``,
        and rewrite parts whose buckets have become too large; the rewrites made.

        A merged part is one level up and merges with its likes only, so a row
        is rewritten once per level, and parts grow with the logarithm of the
        number of appends.
        """
        for rewrites in count():
            state = self.state()
            merging = [p for p in state.parts if p.merges]
            large = sum(p.rows for p in merging) * MERGE_SHARE > sum(p.rows for p in state.parts if not p.merges)
            if merging and (len(merging) > most_merges or large):
                self._fold(state)
                continue
            alike: dict[int, list[Part]] = {}
            for part in state.parts:
                if not part.merges:
                    alike.setdefault(part.level, []).append(part)
            crowded = [parts for _, parts in sorted(alike.items()) if len(parts) > most_parts]
            outgrown = [
                [p] for p in state.parts
                if not p.merges and p.buckets < state.buckets and p.size > 2 * p.buckets * self.bucket_bytes
            ]
            if not crowded and not outgrown:
                return rewrites
            if merging:  # rows that are rewritten come behind merged parts, which have to be in them
                self._fold(state)
                continue
            merged = (crowded or outgrown)[0]
            level = merged[0].level + (1 if crowded else 0)
            part = self._write_part(self._parts(state, merged, None).select(*state.schema.names), state.keys, state.buckets, level)
            kept = tuple(p for p in state.parts if p not in merged)
            self._commit(state, "compact", state.schema, state.keys, state.buckets, (*kept, _slim(part)), part.rows)
        return 0

    def _fold(self, state: State) -> None:
        """Rewrite the buckets that merged parts fill."""
        merging = [p for p in state.parts if p.merges]
        filled = {b for p in merging for b in _as_buckets(p.filled, p.buckets, state.buckets)}
        closed = _closed(filled, state)
        part = self._write_part(self._read(state, closed), state.keys, state.buckets)
        self._commit(state, "fold", state.schema, state.keys, state.buckets, (*_without(state, closed), _slim(part)), part.rows)

    def upsert(
        self,
        df: DataFrame,
        sequence: str | None = None,
        update: bool = True,
        run_id: str | None = None,
        batch_id: int | None = None,
        broadcast_bytes: int = BROADCAST_KEY_BYTES,
    ) -> int:
        """Merge rows by key into the buckets they fall in (K4, K5, K7).

        Repeated keys need a ``sequence`` that tells the last one; a row that is
        older by it than the stored row of its key is left out, so the answer
        doesn't depend on how rows fall into calls. A repeated
        ``(run_id, batch_id)`` changes nothing. The source is reduced to one
        row per key and staged. If it is small against the buckets it falls in,
        it is written as it is, to be merged by readers. Else these buckets are
        rewritten in one of two ways: when its keys are small they are broadcast
        and old rows are not shuffled; else old and new rows are shuffled once,
        by bucket.
        """
        state = self._require(df)
        if not state.keys:
            raise ValueError("an upsert needs a table with a key")
        if batch_id is not None and state.batches.get(run_id, -1) >= batch_id:
            return 0  # a repeated batch
        keys = list(state.keys)
        if sequence:
            df = last_per_key(df, keys, sequence)
        staged_path = shared_dir(self.spark, "upsert")
        scratch = [staged_path]
        df.select(*state.schema.names).write.parquet(staged_path)
        source = self.spark.read.schema(state.schema).parquet(staged_path)
        affected, key_bytes, new_rows = self._affected(source, state, unique=bool(sequence))
        closed = _closed(set(affected), state)
        old = self._read(state, closed)
        share = {p.name: len({b % p.buckets for b in closed}) / p.buckets for p in state.parts}
        if sequence in state.schema.names and sequence not in keys:
            scratch.append(shared_dir(self.spark, "upsert"))
            source = self._not_older(source, old, keys, sequence, key_bytes <= broadcast_bytes, scratch[-1])
        rest = [c for c in state.schema.names if c not in keys]
        buckets = self._grown(state, run_id, batch_id)
        merges = False
        if not rest or not update:
            # Insert only: existing rows stay where they are.
            fresh = source.join(old.select(*keys), keys, "left_anti").select(*state.schema.names)
            part, parts = self._write_part(fresh, keys, buckets), state.parts
        elif new_rows * MERGE_SHARE <= sum(p.rows * share[p.name] for p in state.parts):
            part, parts, merges = self._write_part(source, keys, buckets), state.parts, True
        else:
            bucket = key_bucket(keys, buckets)
            if key_bytes <= broadcast_bytes:
                # Old rows stay in their tasks, which hold few buckets each;
                # new rows are brought together by bucket.
                kept = old.join(F.broadcast(source.select(*keys)), keys, "left_anti")
                kept = kept.select(*state.schema.names, bucket.alias(BUCKET))
                fresh = source.withColumn(BUCKET, bucket).hint("rebalance", BUCKET)
                merged = kept.unionByName(fresh)
            else:
                old_bytes = sum(p.size * share[p.name] for p in state.parts)
                sized = int(old_bytes // BUCKET_BYTES) + 1 + partitions_by_size(source)
                merged = _newest(old, source, keys, bucket, len(_as_buckets(closed, state.buckets, buckets)), sized)
            part, parts = self._write_part(merged, keys, buckets), _without(state, closed)
        added = part.filled
        part = replace(part, merges=merges) if merges else _slim(part)
        self._commit(
            state, "upsert", state.schema, keys, buckets, (*parts, part), part.rows, run_id, batch_id, added=_as_buckets(added, buckets, state.buckets)
        )
        for path in scratch:  # the rows are in the table now
            drop_folder(self.spark, path)
        if merges:
            self.compact()
        return part.rows

    def write(self, df: DataFrame, keys: Sequence[str] = (), fresh: bool = False, **options) -> int:
        """Pick the way to write (K8): fresh tables are replaced, tables with
        a key are merged into, others are appended to."""
        state = self.state()
        if fresh or state is None:
            kept = {k: v for k, v in options.items() if k in ("buckets", "sequence", "run_id")}
            return self.overwrite(df, keys, **kept)
        kept = {k: v for k, v in options.items() if k in ("sequence", "run_id", "batch_id")}
        if state.keys:
            return self.upsert(df, **kept)
        kept.pop("sequence", None)
        return self.append(df, **kept)

    # -- inside -----------------------------------------------------------

    def _require(self, df: DataFrame) -> State:
        state = self.state()
        if state is None:
            raise FileNotFoundError(f"no table at {self.path}")
        missing = [c for c in state.schema.names if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing in the rows to write: {', '.join(missing)}")
        return state

    def buckets_of_run(self, run_id: str) -> set[int]:
        """Buckets some commit of a run wrote to."""
        mine = self.manifest().where(F.col("run_id") == run_id)
        return {r[0] for r in mine.select(F.explode("added")).distinct().collect()}

    def covered_by_run(self, run_id: str) -> set[int]:
        """Batches the commits of a run name as theirs."""
        mine = self.manifest().where(F.col("run_id") == run_id)
        return {r[0] for r in mine.select(F.explode("covers")).distinct().collect()}

    def _not_older(
        self, source: DataFrame, old: DataFrame, keys: list[str], sequence: str, small: bool, path: str
    ) -> DataFrame:
        """Source rows no stored row of their key is newer than, staged.

        Only keys and sequence of the stored rows are read. Equal sequences
        count as newer: the later write wins.
        """
        named = F.broadcast(source.select(*keys)) if small else source.select(*keys)
        met = old.select(*keys, sequence).join(named, keys, "left_semi")
        stored = met.groupBy(*keys).agg(F.max(sequence).alias("_stored"))
        newest = source.join(stored, keys, "left").where(
            F.col("_stored").isNull() | (F.col(f"`{sequence}`") >= F.col("_stored"))
        )
        newest.drop("_stored").select(*source.columns).write.parquet(path)
        return self.spark.read.schema(source.schema).parquet(path)

    def _affected(self, source: DataFrame, state: State, unique: bool) -> tuple[list[int], int, int]:
        """Buckets the source falls in, the bytes of its keys, and its rows.

        Refuses NULL and repeated keys. One row per bucket reaches the driver.
        """
        keys = [F.col(f"`{k}`") for k in state.keys]
        absent = reduce(lambda a, b: a | b, [k.isNull() for k in keys])
        width = sum((F.octet_length(k.cast("string")) + 16 for k in keys), F.lit(0))
        per_bucket = source.groupBy(key_bucket(state.keys, state.buckets).alias(BUCKET)).agg(
            F.count_if(absent).alias("absent"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"), F.count("*").alias("rows")
        )
        found = per_bucket.collect()
        if missing := sum(r.absent for r in found):
            raise ValueError(f"{missing} rows have no key")
        if not unique and not source.groupBy(*keys).count().where("count > 1").isEmpty():
            raise DuplicateKeys("keys repeat in the source; name a sequence column")
        return [r[BUCKET] for r in found], sum(r.bytes for r in found), sum(r.rows for r in found)

    def _write_part(
        self, df: DataFrame, keys: Sequence[str], buckets: int, level: int = 0, expected: int | None = None
    ) -> Part:
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/{PART}={name}"
        seen = Observation()
        counted = F.count(F.lit(1)).alias("rows")
        if not keys:
            df.observe(seen, counted).write.parquet(folder, compression=self.codec)
            return Part(name, False, level, 1, seen.get["rows"], folder_bytes(self.spark, folder), (0,))
        folders = self._folders(buckets)
        rows = df if BUCKET in df.columns else df.withColumn(BUCKET, key_bucket(keys, buckets))
        place = BUCKET
        if folders < buckets:
            place = _FOLDER
            rows = rows.withColumn(place, F.col(BUCKET) % folders)
        if BUCKET not in df.columns and not _direct(df, folders, expected):
            # Rebalance keeps a folder together, splits an oversized one into
            # several files and joins small ones into one task.
            rows = rows.hint("rebalance", folders, place)
        rows = rows.observe(seen, counted, F.collect_set(BUCKET).alias("filled"))
        if folders < buckets:
            rows = rows.drop(BUCKET).withColumnRenamed(place, BUCKET)
        rows.write.partitionBy(BUCKET).parquet(folder, compression=self.codec)
        filled = tuple(sorted(seen.get["filled"]))
        return Part(
            name, False, level, buckets, seen.get["rows"], folder_bytes(self.spark, folder), filled,
            folders=folders if folders < buckets else None,
        )

    def _folders(self, buckets: int) -> int:
        """Folders of a part: buckets are put together two by two while a folder is small."""
        folders = buckets
        while folders % 2 == 0 and 2 * (buckets // folders) * self.bucket_bytes <= FOLDER_BYTES:
            folders //= 2
        return folders

    def _commit(
        self,
        state: State | None,
        kind: str,
        schema: T.StructType,
        keys: Sequence[str],
        buckets: int,
        parts: Sequence[Part],
        rows: int,
        run_id: str | None = None,
        batch_id: int | None = None,
        covers: Sequence[int] | None = None,
        added: Iterable[int] = (),
    ) -> None:
        number = (state.commit_no if state else 0) + 1
        folder = f"{self.path}/manifest/version={number:010d}"
        staged = f"{self.path}/commits/{uuid.uuid4().hex}"
        nullable = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])
        batches = dict(state.batches) if state else {}
        if batch_id is not None:
            batches[run_id] = batch_id
        row = [
            (
                number, kind, run_id, batch_id, batches, nullable.json(), list(keys), buckets, rows,
                sorted(added), [(*astuple(p)[:6], list(p.filled), list(p.dead), p.folders) for p in parts],
                None if covers is None else list(covers),
            )
        ]
        fields = MANIFEST_SCHEMA.rsplit(",", 1)[0]
        (
            self.spark.createDataFrame(row, fields)
            .withColumn("committed_at", F.current_timestamp())
            .coalesce(1)
            .write.mode("overwrite")
            .parquet(staged)
        )
        if not rename_folder(self.spark, staged, folder):
            raise ConcurrentWrite(f"{self.path} has a commit {number} already")


def _direct(df: DataFrame, folders: int, expected: int | None) -> bool:
    """Whether counted rows are so many that tasks fill files of a folder well without a shuffle.

    A plan's estimate knows of no filter, and a count of no bytes: the smaller of both tells. Where the plan knows no
    size, as of a database, rows may come in one task; they are shuffled.
    """
    if expected is None or folders > DIRECT_FOLDERS:
        return False
    wanted = folders * FOLDER_BYTES
    return expected * df._jdf.schema().defaultSize() >= wanted and wanted <= plan_bytes(df) < UNKNOWN_BYTES


def _slim(part: Part) -> Part:
    """A part of plain rows: which buckets it fills is not needed again."""
    return replace(part, filled=())


def _as_buckets(buckets: Iterable[int], number: int, wanted: int) -> set[int]:
    """The buckets of ``wanted`` in which rows of some of ``number`` buckets may lie; one number divides the other."""
    if wanted <= number:
        return {b % wanted for b in buckets}
    return {b + k for b in buckets for k in range(0, wanted, number)}


def _closed(buckets: set[int], state: State) -> set[int]:
    """Buckets with all that share a folder with them in some part written with fewer buckets."""
    least = min((p.buckets for p in state.parts), default=state.buckets)
    return _as_buckets(_as_buckets(buckets, state.buckets, least), least, state.buckets)


def _without(state: State, buckets: set[int]) -> tuple[Part, ...]:
    """The parts of a table whose buckets have been rewritten; those that are all dead go."""
    marked = [replace(p, dead=tuple(sorted({*p.dead, *_as_buckets(buckets, state.buckets, p.buckets)}))) for p in state.parts]
    return tuple(p for p in marked if not (set(p.filled) <= set(p.dead) if p.merges else len(p.dead) >= p.buckets))


def _newest(
    old: DataFrame, source: DataFrame, keys: list[str], bucket: Column, buckets: int, sized: int
) -> DataFrame:
    """New rows, and the old ones whose key no new row has, in one shuffle.

    Rows are shuffled by bucket, which is how the result is written, and the
    window needs rows of a key together, which that already gives. Buckets
    larger than a partition should be are cut into slices of their keys.
    """
    slices = -(-max(sized, buckets) // buckets)
    piece = F.pmod(F.hash(*[F.col(f"`{k}`") for k in keys]), F.lit(slices))
    both = old.withColumn("_new", F.lit(0)).unionByName(source.withColumn("_new", F.lit(1)))
    both = both.withColumns({BUCKET: bucket, "_slice": piece})
    both = both.repartition(buckets * slices, BUCKET, "_slice")
    # An old row goes only when a new one has its key: keys may repeat among
    # old rows, and NULL keys (never among new rows) match nothing.
    by_key = Window.partitionBy(BUCKET, "_slice", *[F.col(f"`{k}`") for k in keys])
    marked = both.withColumn("_replaced", F.max("_new").over(by_key))
    return marked.where("_new = 1 or _replaced = 0").drop("_new", "_replaced", "_slice")
