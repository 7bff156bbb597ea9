"""Token files coded with a static range asymmetric numeral system.

One frequency table, counted over all tokens, is shared by all files. Documents are sorted by id,
dealt into files by range, and their ids are coded in blocks that can be decoded independently. A block
interleaves several coder states (lanes): token k belongs to lane k mod lanes, so whole steps of all
lanes are coded with array operations. Every few steps the states are kept as a checkpoint, from which
decoding can start inside a block; every block and index has a checksum.

A file: blocks, the index of its documents (id, first token), the directory of its blocks, a trailer.
What a task writes has a name of its own and counts only when the manifest (Parquet, committed by Spark)
names it, so lost executors and repeated tasks leave nothing that is read.

Defined cases: NULL and empty texts are documents of the end id alone; NULL ids come first; rows with
the same id are separate documents, ordered by their ids; an empty table gives a folder without files
and an empty result. Extra columns are not stored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drayline.llm.base import RangeReader, attempt_name, staged, texts_of, write_file
from drayline.llm.bpe import byte_bpe

LOW_BITS = 31  # states lie in [2 ** 31, 2 ** 63) between steps; words of 32 bits go in and out
BLOCK_HEAD = struct.Struct("<IIII")  # tokens, lanes, steps between checkpoints, words
TRAILER = struct.Struct("<QQIQQI8s")  # index: offset, bytes, crc32; directory: offset, bytes, crc32; mark
MARK = b"drayans1"
DIRECTORY = np.dtype([("offset", "<u8"), ("size", "<u4"), ("crc32", "<u4"), ("first", "<u8"), ("tokens", "<u4")])
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("first", "<u8"), ("tokens", "<u8")])


@dataclass(frozen=True)
class TokenFileOptions:
    tokenizer: str = ""  # path of a byte-level BPE file; empty: the public 50k one
    end_id: int = 2  # appended to each document
    block_tokens: int = 1 << 18
    lanes: int = 512
    checkpoint_steps: int = 128
    file_tokens: int = 1 << 26  # of a file, on average
    unit_blocks: int = 8  # blocks a reading task takes at once


def tokenizer_path(options: TokenFileOptions) -> str:
    if options.tokenizer:
        return options.tokenizer
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- the coder ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Table:
    """Symbols with their shares of 2 ** bits slots."""

    symbols: np.ndarray
    shares: np.ndarray
    bits: int

    @staticmethod
    def of(symbols: np.ndarray, counts: np.ndarray) -> Table:
        """Shares in proportion to counts, at least 1 each."""
        order = np.argsort(symbols)
        symbols, counts = symbols[order].astype(np.uint32), counts[order].astype(np.float64)
        bits = min(24, max(12, int(len(symbols)).bit_length() + 4))
        slots = 1 << bits
        if not len(symbols):
            return Table(symbols, np.zeros(0, np.uint64), bits)
        shares = np.maximum(1, np.floor(counts / counts.sum() * slots)).astype(np.int64)
        # the difference goes to or comes from the frequent symbols, where it costs least
        for i in np.argsort(-counts, kind="stable"):
            gap = slots - shares.sum()
            if gap == 0:
                break
            shares[i] = shares[i] + gap if gap > 0 else max(1, shares[i] + gap)
        return Table(symbols, shares.astype(np.uint64), bits)

    @property
    def starts(self) -> np.ndarray:
        return (np.cumsum(self.shares) - self.shares).astype(np.uint64)

    def to_bytes(self) -> bytes:
        body = struct.pack("<II", self.bits, len(self.symbols)) + self.symbols.astype("<u4").tobytes()
        body += self.shares.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @staticmethod
    def from_bytes(raw: bytes) -> Table:
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("the frequency table is damaged")
        bits, n = struct.unpack("<II", raw[:8])
        numbers = np.frombuffer(raw[8:-4], "<u4")
        return Table(numbers[:n].astype(np.uint32), numbers[n:].astype(np.uint64), bits)


class Coder:
    """Codes and decodes blocks with one table."""

    def __init__(self, table: Table):
        self.table = table
        self.starts = table.starts
        size = int(table.symbols.max()) + 1 if len(table.symbols) else 0
        self.rank = np.full(size, -1, np.int64)
        self.rank[table.symbols] = np.arange(len(table.symbols))
        self.by_slot = np.repeat(np.arange(len(table.symbols), dtype=np.int32), table.shares.astype(np.int64))
        self.bits, self.mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)

    def encode(self, tokens: np.ndarray, options: TokenFileOptions) -> bytes:
        n = len(tokens)
        lanes = max(1, min(options.lanes, n // 64))
        steps = -(-n // lanes)
        rank = self.rank[tokens]
        if n and rank.min() < 0:
            raise ValueError("a token is missing from the frequency table")
        share, start = self.table.shares[rank], self.starts[rank]
        most = share << np.uint64(63 - self.table.bits)
        state = np.full(lanes, 1 << LOW_BITS, np.uint64)
        words: list[np.ndarray] = []
        kept: list[tuple[int, np.ndarray]] = []
        written = 0
        word = np.uint64(32)
        for step in range(steps - 1, -1, -1):
            at = slice(step * lanes, min((step + 1) * lanes, n))
            f, x = share[at], state[: at.stop - at.start]
            full = x >= most[at]
            if full.any():
                words.append(x[full].astype(np.uint32))
                written += len(words[-1])
                x = np.where(full, x >> word, x)
            turns = x // f
            state[: len(x)] = (turns << self.bits) + (x - turns * f) + start[at]
            if step % options.checkpoint_steps == 0:
                kept.append((written, state.copy()))
        words.reverse()
        kept.reverse()
        places = np.array([written - w for w, _ in kept], "<u4")
        states = np.array([s for _, s in kept], "<u8")
        body = np.concatenate(words).astype("<u4") if words else np.zeros(0, "<u4")
        head = BLOCK_HEAD.pack(n, lanes, options.checkpoint_steps, len(body))
        return head + places.tobytes() + states.tobytes() + body.tobytes()

    def decode(self, raw: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Tokens begin..end of a block, starting at the last checkpoint before them."""
        n, lanes, every, n_words = BLOCK_HEAD.unpack_from(raw)
        end = n if end is None else end
        if begin >= end:
            return np.zeros(0, np.uint32)
        steps = -(-n // lanes)
        points = -(-steps // every)
        at = BLOCK_HEAD.size
        places = np.frombuffer(raw, "<u4", points, at)
        states = np.frombuffer(raw, "<u8", points * lanes, at + 4 * points).reshape(points, lanes)
        words = np.frombuffer(raw, "<u4", n_words, at + 4 * points + 8 * points * lanes).astype(np.uint64)
        point = begin // lanes // every
        state, place = states[point].astype(np.uint64), int(places[point])
        first = point * every
        last = -(-end // lanes)
        out = np.empty((last - first) * lanes, np.int32)
        low, word = np.uint64(1 << LOW_BITS), np.uint64(32)
        shares, starts, by_slot = self.table.shares, self.starts, self.by_slot
        for step in range(first, last):
            size = min(lanes, n - step * lanes)
            x = state[:size]
            slot = x & self.mask
            rank = by_slot[slot]
            out[(step - first) * lanes : (step - first) * lanes + size] = rank
            x = shares[rank] * (x >> self.bits) + slot - starts[rank]
            short = np.flatnonzero(x < low)
            if len(short):
                x[short] = (x[short] << word) | words[place : place + len(short)]
                place += len(short)
            state[:size] = x
        return self.table.symbols[out[begin - first * lanes : end - first * lanes]]


# --- files ----------------------------------------------------------------------------------------


def file_chunks(documents: Iterator[tuple[int | None, np.ndarray]], coder: Coder, options: TokenFileOptions, seen: dict):
    """The bytes of a file, block by block; ``seen`` gets its counts."""
    offset = total = held = 0
    buffer: list[np.ndarray] = []
    directory, index = [], []

    def block(tokens: np.ndarray, first: int) -> bytes:
        nonlocal offset
        raw = coder.encode(tokens, options)
        directory.append((offset, len(raw), zlib.crc32(raw), first, len(tokens)))
        offset += len(raw)
        return raw

    for doc_id, ids in documents:
        index.append((doc_id or 0, doc_id is None, total, len(ids)))
        total += len(ids)
        buffer.append(ids)
        held += len(ids)
        if held >= options.block_tokens:
            tokens = np.concatenate(buffer)
            whole = held - held % options.block_tokens
            for at in range(0, whole, options.block_tokens):
                yield block(tokens[at : at + options.block_tokens], total - held + at)
            buffer, held = [tokens[whole:].copy()], held - whole
    if held:
        yield block(np.concatenate(buffer), total - held)
    index_raw = zlib.compress(np.array(index, INDEX).tobytes(), 1)
    directory_raw = np.array(directory, DIRECTORY).tobytes()
    yield index_raw
    yield directory_raw
    yield TRAILER.pack(
        offset, len(index_raw), zlib.crc32(index_raw),
        offset + len(index_raw), len(directory_raw), zlib.crc32(directory_raw), MARK,
    )
    seen |= {"documents": len(index), "tokens": total, "blocks": len(directory)}


class TokenFile:
    """One file, read by ranges."""

    def __init__(self, reader: RangeReader, name: str):
        self.reader, self.name = reader, name
        size = reader.size(name)
        tail = TRAILER.unpack(reader.read(name, size - TRAILER.size, TRAILER.size))
        if tail[6] != MARK:
            raise ValueError(f"{name} is no token file")
        index, directory = self._checked(*tail[:3]), self._checked(*tail[3:6])
        self.index = np.frombuffer(zlib.decompress(index), INDEX)
        self.directory = np.frombuffer(directory, DIRECTORY)

    def _checked(self, offset: int, size: int, crc: int) -> bytes:
        raw = self.reader.read(self.name, int(offset), int(size))
        if zlib.crc32(raw) != crc:
            raise ValueError(f"{self.name}: {size} bytes at {offset} are damaged")
        return raw

    def tokens(self, coder: Coder, begin: int, end: int) -> Iterator[np.ndarray]:
        """Tokens begin..end of the file, a block at a time."""
        block = int(np.searchsorted(self.directory["first"], begin, "right")) - 1
        while begin < end:
            entry = self.directory[block]
            first, stop = int(entry["first"]), int(entry["first"] + entry["tokens"])
            raw = self._checked(entry["offset"], entry["size"], entry["crc32"])
            yield coder.decode(raw, begin - first, min(end, stop) - first)
            begin, block = stop, block + 1

    def documents(self, coder: Coder, first_block: int, blocks: int) -> Iterator[tuple[np.void, list[np.ndarray]]]:
        """Index entry and token arrays of the documents that begin in these blocks.

        The blocks are decoded one after the other; the last document may reach into later ones.
        """
        begin = int(self.directory["first"][first_block])
        last = min(first_block + blocks, len(self.directory)) - 1
        limit = int(self.directory["first"][last] + self.directory["tokens"][last])
        low, high = np.searchsorted(self.index["first"], [begin, limit], "left")
        entries = self.index[low:high]
        if not len(entries):
            return
        stream = self.tokens(coder, int(entries["first"][0]), int(entries["first"][-1] + entries["tokens"][-1]))
        rest = np.zeros(0, np.uint32)
        for entry in entries:
            parts, wanted = [], int(entry["tokens"])
            while wanted:
                if not len(rest):
                    rest = next(stream)
                parts.append(rest[:wanted])
                wanted -= len(parts[-1])
                rest = rest[len(parts[-1]) :]
            yield entry, parts


@lru_cache(maxsize=2)
def _coder(raw: bytes) -> Coder:
    return Coder(Table.from_bytes(raw))


# --- Spark ----------------------------------------------------------------------------------------


def tokenized(documents: DataFrame, options: TokenFileOptions) -> DataFrame:
    """(doc_id, ids) with the ids, end id included, as compressed bytes; staged: encoded once."""
    path, end_id = tokenizer_path(options), options.end_id

    def run(batches):
        tool, pack = byte_bpe(path), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], tool.kind).tobytes()
        for batch in batches:
            ids = [pack.compress(raw + end) for raw in tool.encode(texts_of(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(run, "doc_id bigint, ids binary"), "tokens")


def unpacked(column: pa.Array, kind: np.dtype) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    for raw in column:
        yield np.frombuffer(unpack.decompress(raw.as_py()), kind)


def token_counts(tokens: DataFrame, kind: np.dtype) -> Table:
    """The frequency table of all tokens: one row per task and token, then one per token of the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in unpacked(batch.column("ids"), kind):
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    counted = tokens.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most the vocabulary
    return Table.of(found.column("token").to_numpy(), found.column("n").to_numpy())


def write_tokens(documents: DataFrame, folder: str, options: TokenFileOptions = TokenFileOptions()) -> DataFrame:
    """Encode the texts and write the files below ``folder``. Returns the manifest, one row per file."""
    spark = documents.sparkSession
    kind = byte_bpe(tokenizer_path(options)).kind
    tokens = tokenized(documents, options)
    table = token_counts(tokens, kind)
    raw_table = table.to_bytes()
    write_file(folder, "table.bin", [raw_table])
    total = int(tokens.agg(F.sum(F.length("ids"))).first()[0] or 0)  # about a byte per token
    fewest = min(2 * spark.sparkContext.defaultParallelism, -(-total // (1 << 20)))
    files = max(-(-total // options.file_tokens), fewest, 1)

    def run(batches):
        seen: dict = {}
        coder = _coder(raw_table)

        def rows():
            for batch in batches:
                yield from zip(batch.column("doc_id").to_pylist(), unpacked(batch.column("ids"), kind), strict=True)

        documents = rows()
        first = next(documents, None)
        if first is None:
            return

        def again():
            yield first
            yield from documents

        part = TaskContext.get().partitionId()
        name = attempt_name(f"tokens-{part:06d}")
        size = write_file(folder, name, file_chunks(again(), coder, options, seen))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in (part, name, size, seen["documents"], seen["tokens"], seen["blocks"])],
            ["part", "name", "bytes", "documents", "tokens", "blocks"],
        )

    schema = "part bigint, name string, bytes bigint, documents bigint, tokens bigint, blocks bigint"
    ordered = tokens.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


DOCUMENT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False, unit_blocks: int = 8) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read back from the files.

    A task takes some blocks of a file, so a file is decoded by many tasks.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    # the sums first: in one select with explode they would run over units instead of files
    placed = manifest.select("name", "blocks", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    units = placed.select(
        "name",
        "base",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(unit_blocks).cast("long"))).alias("block"),
    )
    number = manifest.agg(F.sum(F.ceil(F.col("blocks") / unit_blocks))).first()[0] or 1

    def run(batches):
        reader = RangeReader(folder)
        reader_table = reader.read("table.bin", 0, reader.size("table.bin"))
        coder, file = _coder(reader_table), None
        for batch in batches:
            for unit in batch.to_pylist():
                if file is None or file.name != unit["name"]:
                    file = TokenFile(reader, unit["name"])
                rows: list[tuple] = []
                held = 0
                for entry, parts in file.documents(coder, unit["block"], unit_blocks):
                    crc = 0
                    for part in parts:
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    doc_id = None if entry["is_null"] else int(entry["doc_id"])
                    row = (doc_id, unit["base"] + int(entry["first"]), int(entry["tokens"]), crc)
                    rows.append((*row, np.concatenate(parts).astype(np.int32)) if with_ids else row)
                    held += int(entry["tokens"])
                    if with_ids and held > 1 << 22:
                        yield _document_batch(rows, with_ids)
                        rows, held = [], 0
                if rows:
                    yield _document_batch(rows, with_ids)
        reader.close()

    schema = DOCUMENT + (", ids array<int>" if with_ids else "")
    return units.repartition(min(int(number), 100_000)).mapInArrow(run, schema)


def _document_batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
