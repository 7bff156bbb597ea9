"""Token counts of documents in flat token files, by a scan for separators.

A flat file is nothing but token ids, one after the other, each document closed by an end-of-document id: no
header, no index. The scan cuts files into blocks of a fixed size that are read by range and searched for the
end id with one array comparison each. A block knows where its documents end, and all their starts
but the first: that lies behind the last end of the blocks before. A prefix scan over the blocks
of a file (documents before the block, place behind the last end before it) stitches the borders.

Defined cases: NULL and empty texts are documents of the end id alone; tokens after a file's last end are
a document that isn't closed; an end id's string inside a text is encoded as ordinary text, so texts hold
no separators; a file whose size is no multiple of the id's size raises; NULL and repeated ids are kept as
they are; an empty table gives no file and an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drayline.llm.base import RangeReader, attempt_name, staged, texts_of, write_file
from drayline.llm.bpe import byte_bpe


@dataclass(frozen=True)
class FlatOptions:
    tokenizer: str = ""  # path of a byte-level BPE file; empty: the public 50k one
    end_id: int = 50256
    block_bytes: int = 4 << 20
    width: int = 2  # bytes of an id


def tokenizer_path(options: FlatOptions) -> str:
    if options.tokenizer:
        return options.tokenizer
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


NAMES = "name string, number bigint, doc_id bigint"


def write_flat(documents: DataFrame, folder: str, options: FlatOptions = FlatOptions()) -> DataFrame:
    """Encode texts into flat files, one per task, in the order they are read: nothing is shuffled.

    Returns (name, number, doc_id): which document is the number-th of a file. It names the files that
    count, and holds no lengths or places.
    """
    path, end_id, kind = tokenizer_path(options), options.end_id, np.dtype(f"<u{options.width}")

    def run(batches):
        tool = byte_bpe(path, True)
        if tool.size > 256**options.width or end_id >= 256**options.width:
            raise ValueError(f"ids of this tokenizer need more than {options.width} bytes")
        end = np.array([end_id], kind).tobytes()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        ids: list = []

        def chunks():
            batch = first
            while batch is not None:
                ids.append(batch.column("doc_id"))
                for raw in tool.encode(texts_of(batch.column("text"))):
                    yield (raw if tool.kind == kind else np.frombuffer(raw, tool.kind).astype(kind).tobytes()) + end
                batch = next(batches, None)

        name = attempt_name("flat")
        write_file(folder, name, chunks())
        number = 0
        for column in ids:
            numbers = pa.array(np.arange(number, number + len(column)))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(column)), numbers, column], ["name", "number", "doc_id"])
            number += len(column)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(run, NAMES), "flat-names")


ENDS = "name string, block bigint, k bigint, begin bigint, last bigint, closed boolean"


def scan_ends(names: DataFrame, folder: str, options: FlatOptions = FlatOptions()) -> DataFrame:
    """A row for every document's last token: file, block, k-th of the block, first token if in the block, last token."""
    kind, end_id, size = np.dtype(f"<u{options.width}"), options.end_id, options.block_bytes
    block_ids = size // options.width

    def sizes(batches):
        reader = RangeReader(folder)
        for batch in batches:
            files = batch.column(0).to_pylist()
            blocks, counts = [], []
            for name in files:
                count, odd = divmod(reader.size(name), options.width)
                if odd:
                    raise ValueError(f"{name} ends inside an id")
                counts.append(count)
                blocks.append(-(-count // block_ids))
            arrays = [pa.array(files, pa.string()), pa.array(counts, pa.int64()), pa.array(blocks, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["name", "ids", "blocks"])
        reader.close()

    def scan(batches):
        reader = RangeReader(folder)
        for batch in batches:
            for name, total, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                offset = block * block_ids
                here = min(block_ids, total - offset)
                ids = np.frombuffer(reader.read(name, offset * options.width, here * options.width), kind)
                last = np.flatnonzero(ids == end_id) + offset
                closed = np.ones(len(last), bool)
                if offset + here == total and ids[-1] != end_id:
                    last, closed = np.append(last, total - 1), np.append(closed, False)
                begin = pa.array(np.concatenate([[0], last[:-1] + 1]), mask=np.arange(len(last)) == 0) if len(last) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(last), pa.string()),
                        pa.array(np.full(len(last), block)),
                        pa.array(np.arange(len(last))),
                        pa.array(begin, pa.int64()),
                        pa.array(last),
                        pa.array(closed),
                    ],
                    [c.split()[0] for c in ENDS.split(", ")],
                )
        reader.close()

    files = names.select("name").distinct().mapInArrow(sizes, "name string, ids bigint, blocks bigint")
    files = staged(files, "flat-files")
    number = files.agg(F.sum("blocks")).first()[0] or 1
    blocks = files.where("blocks > 0").select("name", "ids", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    return blocks.repartition(min(int(number), 100_000)).mapInArrow(scan, ENDS)


def token_counts(names: DataFrame, folder: str, options: FlatOptions = FlatOptions()) -> DataFrame:
    """(name, number, start, n_tokens, closed) of every document of the files; end ids count."""
    ends = staged(scan_ends(names, folder, options), "flat-ends")
    # blocks without an end change nothing behind them: they aren't here
    per_block = ends.groupBy("name", "block").agg(F.count("*").alias("n"), F.max("last").alias("last"))
    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = per_block.select(
        "name",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("number_before"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("open_since"),
    )
    start = F.coalesce("begin", "open_since")
    return ends.join(stitched, ["name", "block"]).select(
        "name",
        (F.col("number_before") + F.col("k")).alias("number"),
        start.alias("start"),
        (F.col("last") - start + 1).alias("n_tokens"),
        "closed",
    )


def counted_documents(documents: DataFrame, folder: str, options: FlatOptions = FlatOptions()) -> DataFrame:
    """(doc_id, n_tokens) of documents written to flat files, counted by the scan alone."""
    names = write_flat(documents, folder, options)
    counts = token_counts(names, folder, options)
    return names.join(counts, ["name", "number"]).select("doc_id", "n_tokens")


def count_files(spark: SparkSession, folder: str, names: list[str], options: FlatOptions = FlatOptions()) -> DataFrame:
    """The counts of given flat files of a folder."""
    return token_counts(spark.createDataFrame([(n,) for n in names], "name string"), folder, options)
