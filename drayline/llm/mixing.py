"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash of their id and queued, once per epoch. A
document's virtual finish time is the words its source has queued up to its end, divided by the
source's target. All sources reach their targets at time 1, so the documents range-sorted by finish
time, truncated where the total budget is used up, are the mix.

Both orders, the queues and the mix, are made by a range-sort of narrow rows (ids, sizes, keys):
sizes are summed inside each range, and the sums of the ranges before are added. No queue, source or
id is held by one task: every row has a number of its own, the last of the sort keys, so rows that
agree in all else are cut into ranges too.

Defined cases: a NULL source is a source of its own, ordered last; NULL or empty texts have size 0;
a document of size 0 is never taken (it adds nothing); rows with the same id are queued one after
the other, shorter ones first; very long texts count with all their words, and a document whose last
word lies beyond the budget is left out whole; an empty table gives an empty mix. Columns of the
input with the names of the result are replaced; other extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from drayline.llm.base import staged, word_count

#: Columns of the result; columns of the input with these names are replaced.
ADDED = ("size", "source_size", "target", "taken")
#: Fixed value: ranges of a range-sort at most; their sums are broadcast, one small row each.
MOST_RANGES = 20_000


@dataclass(frozen=True)
class MixOptions:
    weights: tuple[int, ...] = (5, 2, 1)  # dealt to the sources in order, repeating
    share: tuple[int, int] = (3, 2)  # the budget as a fraction of all words
    epochs: int = 2  # a document is taken so many times at most
    seed: int = 17
    slice_rows: int = 50_000  # rows of a range, on average, up to MOST_RANGES ranges


def with_size(df: DataFrame) -> DataFrame:
    return df.withColumn("size", word_count(F.col("text")))


def source_targets(sized: DataFrame, options: MixOptions) -> DataFrame:
    """One row per source: source, source_size, source_rows, weight, target.

    Targets are shares by weight, none above ``epochs`` times its source's size. Ordered by size over
    weight, the capped sources come first: one pass over prefix sums finds them. The windows without
    a partition run over one row per source.
    """
    up, down = options.share
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    weights = F.array(*(F.lit(w) for w in options.weights))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sums.withColumn("rank", rank).withColumn(
        "weight", F.get(weights, F.col("rank") % len(options.weights)).cast("long")
    )
    cap = F.col("source_size") * options.epochs
    by_ratio = Window.orderBy(cap / F.col("weight"), "rank")
    all_rows = Window.partitionBy(F.lit(1))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    walked = ranked.select(
        "*",
        cap.alias("cap"),
        F.sum("source_size").over(all_rows).alias("total"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("cap_before"),
        F.sum("weight").over(onward).alias("weight_onward"),
    )
    capped = F.col("cap") * F.col("weight_onward") * down <= F.col("weight") * (
        F.col("total") * up - F.col("cap_before") * down
    )
    marked = walked.withColumn("capped", capped)
    free = marked.select(
        "*",
        F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(all_rows).alias("cap_sum"),
        F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(all_rows).alias("free_weight"),
    )
    budget = F.col("total").cast("double") * up / down
    level = (budget - F.col("cap_sum")) / F.when(F.col("free_weight") > 0, F.col("free_weight"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return free.select("source", "source_size", "source_rows", "weight", target.alias("target"))


def source_key() -> Column:
    """The source as text that joins: NULL apart from all others."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))


def range_sums(df: DataFrame, order: list[str], value: str, ranges: int, name: str) -> DataFrame:
    """``df`` range-sorted and staged, with ``running``: the sum of ``value`` up to and including the row.

    ``order`` has to tell all rows apart. One shuffle: a task sums its own range, the sums of the ranges are few.
    """
    ordered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = StructType([*df.schema, StructField("range", LongType()), StructField("inside", LongType())])

    def with_sums(batches):
        number, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            inside = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False), dtype=np.int64) + before
            before = int(inside[-1]) if len(inside) else before
            numbers = pa.array(np.full(len(inside), number, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, numbers, pa.array(inside)], [*batch.schema.names, "range", "inside"]
            )

    summed = staged(ordered.mapInArrow(with_sums, schema), name)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = summed.groupBy("range").agg(F.max("inside").alias("range_sum"))
    bases = sums.select("range", F.coalesce(F.sum("range_sum").over(earlier), F.lit(0)).alias("range_base"))
    placed = summed.join(F.broadcast(bases), "range")  # MOST_RANGES rows at most
    return placed.withColumn("running", F.col("range_base") + F.col("inside")).drop("range", "inside", "range_base")


def numbered(df: DataFrame, options: MixOptions) -> DataFrame:
    """The rows without text, staged, with size, source_key, shuffle_key, text_key and a number (``_row``) each."""
    key = F.md5(F.concat(F.lit(f"{options.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = with_size(df.drop(*(set(ADDED) - {"source", "doc_id"}))).select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in ("text", *ADDED))).alias("_own"),
        "doc_id", "source", "size",
        source_key().alias("source_key"), key.alias("shuffle_key"), F.xxhash64("text").alias("text_key"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return staged(sized, "mix-sizes")


def taken_copies(rows: DataFrame, targets: DataFrame, options: MixOptions) -> DataFrame:
    """The copies inside the budget: a row per document and epoch taken, with its ``finish`` and place (``running``)."""
    up, down = options.share
    total, count = targets.agg(F.sum("source_size"), F.sum("source_rows")).first()
    ranges = max(1, min(MOST_RANGES, -(-(count or 0) // options.slice_rows)))
    narrow = rows.where("size > 0").select("source_key", "shuffle_key", "doc_id", "size", "text_key", "_row")
    queued = range_sums(narrow, ["source_key", "shuffle_key", "doc_id", "size", "_row"], "size", ranges, "mix-queue")
    # the sources lie one behind the other: what was queued before a source is the size of those before
    before = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    sources = targets.select(
        source_key().alias("source_key"), "source_size", F.when(F.col("target") > 0, F.col("target")).alias("target")
    ).withColumn("source_base", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    queued = queued.join(sources, "source_key").withColumn("queued", F.col("running") - F.col("source_base"))
    epochs = F.explode(F.array(*(F.lit(e) for e in range(options.epochs))))
    finish = (F.col("source_size") * F.col("epoch") + F.col("queued")) / F.col("target")
    copies = queued.select("*", epochs.alias("epoch")).withColumn("finish", finish).where("finish is not null")
    copies = copies.select("finish", *narrow.columns)
    order = ["finish", "source_key", "shuffle_key", "doc_id", "size", "_row"]
    mixed = range_sums(copies, order, "size", min(MOST_RANGES, ranges * options.epochs), "mix-order")
    return mixed.where(F.col("running") <= F.lit((total or 0) * up / down))


def mix(df: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """The input's rows, without text, with size, source_size, target and taken (words taken, repeats counted)."""
    rows = numbered(df, options)
    targets = staged(source_targets(rows, options), "mix-targets")
    taken = taken_copies(rows, targets, options).groupBy("_row").agg(F.sum("size").alias("taken"))
    figures = targets.select(source_key().alias("source_key"), "source_size", "target")
    return (
        rows.join(taken, "_row", "left")
        .join(figures, "source_key")
        .select("_own.*", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


def mixed_documents(df: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """The mix itself: the taken copies with the input's columns, range-sorted by finish time.

    Queues and budget are settled on ids and sizes alone. Texts are shuffled to meet their places, and into
    the order of the mix. Rows alike in source, id and text are interchangeable: they are numbered on both sides.
    """
    columns = {c: f"_own_{i}" for i, c in enumerate(df.columns)}
    rows = numbered(df.select("doc_id", "source", "text"), options)
    targets = staged(source_targets(rows, options), "mix-targets")
    same = ["source_key", "id_key", "size", "text_key"]
    id_key = F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("")).alias("id_key")
    decided = (
        taken_copies(rows, targets, options)
        .groupBy("source_key", id_key, "size", "text_key", "_row")
        .agg(F.collect_list("running").alias("places"))  # a place per epoch at most
        .withColumn("number", F.row_number().over(Window.partitionBy(*same).orderBy("_row")))
        .select(*same, "number", "places")
    )
    others = F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(n) for c, n in columns.items() if c != "text")))
    texts = (
        df.select(
            source_key().alias("source_key"), id_key, word_count(F.col("text")).alias("size"),
            F.xxhash64("text").alias("text_key"), *(F.col(f"`{c}`").alias(name) for c, name in columns.items()),
        ).withColumn("number", F.row_number().over(Window.partitionBy(*same).orderBy(others, columns["text"])))
    )
    copied = texts.join(decided, [*same, "number"]).withColumn("place", F.explode("places"))
    return copied.orderBy("place").select(*(F.col(name).alias(c) for c, name in columns.items()))
