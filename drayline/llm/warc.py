"""WARC archives with a two-level capture index.

Pages are sorted by reversed-host URL key (``com,example,www)/path``) and id, and dealt by range into
archives. Of pages with the same payload the one with the least id is written as a response, the others
as revisits that refer to it. Next to each archive lies its index: its captures in key order, in compressed
blocks, and a sparse directory of the blocks' first keys. A look-up finds the archives whose key range holds
the key (bounds of all archives, at most ``most_files`` rows), searches the directory of the archive by
bisection, reads the blocks found by range, and from them the records by range.

Look-ups are spread by archive for the search and by block for the reading, so the captures of a URL that a
third of all pages have are read by many tasks. A file counts when the manifest (Parquet, committed by Spark)
names it: what a lost executor leaves is never read.

Defined cases: NULL payloads are empty; payloads of less than ``least_revisit`` bytes are always responses; rows
that repeat the least id of a payload are all responses; NULL ids come first in order, are never referred to,
and if a payload has no other id its rows are all responses; a NULL or unparsable URL has itself (empty)
as key; an empty table gives no archive and empty look-ups. Extra columns are not stored. Very long payloads are
stored whole, each in one record.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.llm.base import RangeReader, attempt_name, column_udf, write_file

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
TAIL = struct.Struct("<QQI8s")  # directory: offset, bytes, crc32; mark
MARK = b"captidx1"


@dataclass(frozen=True)
class WarcOptions:
    least_revisit: int = 100  # bytes of a payload that is written once only
    date: str = "2000-01-01T00:00:00Z"  # WARC-Date of all records: the pages have none
    file_bytes: int = 1 << 29  # payload bytes of an archive, on average
    most_files: int = 10_000  # archives; their key bounds are sent to every search task
    block_entries: int = 512  # captures of an index block
    read_bytes: int = 8 << 20  # neighbouring records are read together up to this size


def url_key(url: Column) -> Column:
    """Host parts from the last to the first, then path and query; fragment, user and default port are left out."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)"
    host = F.lower(F.regexp_replace(F.regexp_extract(url, pattern, 1), r":(80|443)?$", ""))
    rest = F.regexp_extract(url, pattern, 2)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)
    return F.when(url.rlike(pattern), key).otherwise(url)


# --- records --------------------------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, options: WarcOptions) -> bytes:
    """A gzip member with one WARC record."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {options.date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        plain = "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
        lines.append(f"WARC-Target-URI: {plain}")
    block = HTTP_HEAD.format(len(payload)).encode()
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _page_of(uri: str | None) -> int | None:
    number = uri and uri.removeprefix("<urn:x-page:").removesuffix(">")
    return None if not number or number == "null" else int(number)


def parse_record(raw: bytes) -> dict:
    """Fields of a record; a response's payload is checked against its digest."""
    whole = gzip.decompress(raw)
    head, _, rest = whole.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    found = {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": _page_of(fields.get("WARC-Refers-To")),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": None,
    }
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest = hashlib.sha256(payload).hexdigest()
        if (len(payload), digest) != (found["payload_bytes"], found["payload_digest"]):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
        found["payload"] = payload
    return found


# --- writing --------------------------------------------------------------------------------------


def with_references(pages: DataFrame, options: WarcOptions) -> DataFrame:
    """(page_id, url, key, packed, digest, refers_to); packed is the compressed payload."""

    def pack(payloads: pa.Array) -> pa.Array:
        tool = zstandard.ZstdCompressor(level=1)
        return pa.array([tool.compress(x.as_buffer()) for x in payloads], pa.binary())

    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        url_key(F.col("url")).alias("key"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    firsts = (
        rows.where(F.octet_length("payload") >= options.least_revisit)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    packed = rows.withColumn("packed", column_udf(pack, "binary")(F.col("payload"))).drop("payload")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return packed.join(firsts, "digest", "left").withColumn("refers_to", refers).drop("first")


def write_archives(pages: DataFrame, folder: str, options: WarcOptions = WarcOptions()) -> DataFrame:
    """Write archives and indexes below ``folder``. Returns the manifest, one row per archive."""
    spark = pages.sparkSession
    total = int(pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0)
    fewest = min(2 * spark.sparkContext.defaultParallelism, -(-total // (4 << 20)))
    files = min(max(-(-total // options.file_bytes), fewest, 1), options.most_files)

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        part = TaskContext.get().partitionId()
        blocks: list[list] = []  # first key, offset, bytes, entries
        lines: list[str] = []
        index_chunks: list[bytes] = []
        seen = {"offset": 0, "index": 0, "rows": 0, "first": None, "last": None}

        def close_block() -> None:
            if lines:
                raw = zlib.compress("\n".join(lines).encode(), 6)
                blocks.append([json.loads(lines[0])[0], seen["index"], len(raw), len(lines)])
                index_chunks.append(raw)
                seen["index"] += len(raw)
                lines.clear()

        def records(first_batch):
            info = "WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:{}>\r\nWARC-Date: {}\r\n"
            info += "Content-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
            raw = gzip.compress(info.format(part, options.date).encode(), 6, mtime=0)
            seen["offset"] += len(raw)
            yield raw
            batch = first_batch
            while batch is not None:
                for row in batch.to_pylist():
                    payload = unpack.decompress(row["packed"])
                    raw = record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"], options)
                    lines.append(json.dumps([row["key"], row["page_id"], seen["offset"], len(raw)]))
                    seen["offset"] += len(raw)
                    seen["rows"] += 1
                    seen["first"] = row["key"] if seen["first"] is None else seen["first"]
                    seen["last"] = row["key"]
                    if len(lines) == options.block_entries:
                        close_block()
                    yield raw
                batch = next(batches, None)

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        archive = attempt_name(f"pages-{part:05d}") + ".warc.gz"
        write_file(folder, archive, records(first))
        close_block()
        index = attempt_name(f"pages-{part:05d}") + ".cdx"
        write_file(folder, index, [*index_chunks, sealed(blocks, seen["index"])])
        columns = (part, archive, index, seen["first"], seen["last"], seen["rows"], len(blocks))
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], MANIFEST_NAMES)

    sorted_pages = (
        with_references(pages, options)
        .repartitionByRange(files, "key", "page_id")
        .sortWithinPartitions("key", "page_id", "digest")
    )
    sorted_pages.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def sealed(blocks: list[list], offset: int) -> bytes:
    """The end of an index that has its blocks before ``offset``: directory and tail."""
    directory = zlib.compress(json.dumps(blocks).encode(), 6)
    return directory + TAIL.pack(offset, len(directory), zlib.crc32(directory), MARK)


MANIFEST = "part bigint, archive string, cdx string, first_key string, last_key string, n_records bigint, n_blocks bigint"
MANIFEST_NAMES = [x.split()[0] for x in MANIFEST.split(", ")]


# --- reading --------------------------------------------------------------------------------------


class CaptureIndex:
    """The index of one archive: a directory of first keys, and blocks read by range."""

    def __init__(self, reader: RangeReader, name: str):
        self.reader, self.name = reader, name
        size = reader.size(name)
        offset, length, crc, mark = TAIL.unpack(reader.read(name, size - TAIL.size, TAIL.size))
        raw = reader.read(name, offset, length)
        if mark != MARK or zlib.crc32(raw) != crc:
            raise ValueError(f"{name} is no index or damaged")
        self.blocks = json.loads(zlib.decompress(raw))
        self.firsts = [b[0] for b in self.blocks]

    def blocks_of(self, key: str) -> range:
        """Blocks that may hold the key: from the one before the first block that begins with it."""
        low = bisect.bisect_left(self.firsts, key)
        return range(max(low - 1, 0), bisect.bisect_right(self.firsts, key))

    def entries(self, block: int) -> list[list]:
        _, offset, length, _ = self.blocks[block]
        return [json.loads(line) for line in zlib.decompress(self.reader.read(self.name, offset, length)).split(b"\n")]


def runs_of(entries: list[list], most: int) -> Iterator[list[list]]:
    """Neighbouring records, to be read at once."""
    run: list[list] = []
    for entry in entries:
        if run and (run[-1][2] + run[-1][3] != entry[2] or entry[2] + entry[3] - run[0][2] > most):
            yield run
            run = []
        run.append(entry)
    if run:
        yield run


CAPTURE = (
    "key string, page_id bigint, url string, record_type string, refers_to bigint,"
    " payload_bytes bigint, payload_digest string"
)


def reading_tasks(archives: DataFrame) -> int:
    """Tasks to read whole archives with: about eight blocks each, at most eight an archive, two a core if blocks are few."""
    found = archives.agg(F.count("*").alias("files"), F.sum("n_blocks").alias("blocks")).first()
    blocks = found["blocks"] or 1
    few = min(blocks, 2 * archives.sparkSession.sparkContext.defaultParallelism)
    return max(few, min(-(-blocks // 8), 8 * found["files"]))


def captures(
    keys: DataFrame,
    folder: str,
    with_payload: bool = False,
    options: WarcOptions = WarcOptions(),
    tasks: int | None = None,
) -> DataFrame:
    """All captures of the keys in column ``key``, read from the archives; each key counts once.

    ``tasks`` read the records. Without it their number follows the bytes of the look-ups, which suits few keys.
    """
    spark = keys.sparkSession
    archives = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("part").collect()  # most_files at most
    firsts, lasts = [a["first_key"] for a in archives], [a["last_key"] for a in archives]
    names = {a["part"]: (a["archive"], a["cdx"]) for a in archives}
    parts = [a["part"] for a in archives]

    def find_archives(batches):
        for batch in batches:
            found_keys, found_parts = [], []
            for key in batch.column(0).to_pylist():
                for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    found_keys.append(key)
                    found_parts.append(parts[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found_keys, pa.string()), pa.array(found_parts, pa.int64())], ["key", "part"]
            )

    def find_blocks(batches):
        reader, index = RangeReader(folder), None
        for batch in batches:
            rows: list[tuple] = []
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if index is None or index.name != names[part][1]:
                    index = CaptureIndex(reader, names[part][1])
                rows += [(key, part, block) for block in index.blocks_of(key)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["key", "part", "block"]
            )
        reader.close()

    fields = CAPTURE.split(", ") + ["payload binary"] * with_payload
    columns = [f.split()[0] for f in fields]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in fields]

    def read_records(batches):
        cdx, archive = RangeReader(folder), RangeReader(folder)
        index, at, entries, keys = None, None, [], []

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], k) for c, k in zip(columns, kinds, strict=True)], columns
            )

        for batch in batches:
            wanted: dict[tuple, list[list]] = {}
            for key, part, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, block) != at:
                    if index is None or index.name != names[part][1]:
                        index = CaptureIndex(cdx, names[part][1])
                    at, entries = (part, block), index.entries(block)
                    keys = [e[0] for e in entries]
                low, high = bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)
                wanted.setdefault(at, []).extend(entries[low:high])
            for (part, _), found in wanted.items():
                for run in runs_of(found, options.read_bytes):
                    start = run[0][2]
                    raw = archive.read(names[part][0], start, run[-1][2] + run[-1][3] - start)
                    yield batch_of(
                        [parse_record(raw[e[2] - start : e[2] - start + e[3]]) | {"key": e[0]} for e in run]
                    )
        cdx.close()
        archive.close()

    distinct = keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    placed = distinct.mapInArrow(find_archives, "key string, part bigint")
    blocks = placed.repartition("part").sortWithinPartitions("part", "key")
    blocks = blocks.mapInArrow(find_blocks, "key string, part bigint, block bigint")
    spread = blocks.repartition(*([tasks] if tasks else []), "part", "block").sortWithinPartitions("part", "block", "key")
    return spread.mapInArrow(read_records, ", ".join(fields))


def archived(spark: SparkSession, pages: DataFrame, folder: str, options: WarcOptions = WarcOptions()) -> DataFrame:
    """Pages written to archives and looked up again by their URLs."""
    tasks = reading_tasks(write_archives(pages, folder, options))
    return captures(pages.select(url_key(F.col("url")).alias("key")), folder, options=options, tasks=tasks)
