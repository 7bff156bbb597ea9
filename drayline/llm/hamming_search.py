"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its components. A code is cut into segments of about log2(rows) bits, and
for every segment rows are filed by its value. A query probes the values within radius 0 of its own in
one segment after the other, then radius 1, and so on. A row not met when segments 0..j have been probed with
radius s and the others with s - 1 differs in at least m * s + j + 1 bits, so the search ends when the
k-th distance verified so far is at most m * s + j: nothing nearer, and no tie, can be missing.

Equal codes are one row with their k + 1 least ids, all that can be among the k nearest others of any query; equal
queries are searched once. Rows are dealt to shards by hash, queries to blocks; every pair of a shard and a
block is a task that sends home k + 1 rows per query, and the best of all shards are merged.

Defined cases: NULL vectors have no code: they are neither found nor have neighbours; components that are NULL or
NaN count as not positive; shorter vectors are filled up with such; a query never finds its own id;
ties are ordered by id; repeated rows of an id are one; with fewer than k other rows all are returned; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drayline.llm.base import column_udf, staged


@dataclass(frozen=True)
class SearchOptions:
    k: int = 10
    query_step: int = 20  # ids divisible by it are queries
    shard_rows: int = 1 << 17  # distinct codes of a shard, on average
    block_rows: int = 256  # queries of a block, on average
    segment_bits: int = 20  # of a segment, at most


# --- codes ----------------------------------------------------------------------------------------


def sign_codes(vectors: Column, words: int) -> Column:
    """Codes as ``words`` 64-bit words in one binary, a bit per component: is it above 0?"""

    def run(column: pa.Array) -> pa.Array:
        codes = []
        for row in column:
            if not row.is_valid:
                codes.append(None)
                continue
            values = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
            bits = np.zeros(64 * words, np.uint8)
            with np.errstate(invalid="ignore"):
                bits[: len(values)] = values > 0
            codes.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.array(codes, pa.binary())

    return column_udf(run, "binary")(vectors)


# --- one shard ------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of ``bits`` bits with exactly ``radius`` ones."""
    return np.array([sum(1 << b for b in some) for some in combinations(range(bits), radius)], np.int64)


class MultiIndex:
    """Rows of one shard filed by the values of each segment."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bits: int, options: SearchOptions):
        self.codes, self.weights, self.bits = codes, weights, bits
        width = min(max(1, int(np.log2(max(len(codes), 2)))), options.segment_bits, bits)
        count = -(-bits // width)
        edges = [bits * i // count for i in range(count + 1)]
        spread = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")[:, :bits]
        self.segments = []
        for low, high in zip(edges, edges[1:], strict=False):
            values = spread[:, low:high].astype(np.int64) @ (1 << np.arange(high - low, dtype=np.int64))
            order = np.argsort(values, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << (high - low)))])
            self.segments.append((low, high, order, starts))

    def search(self, code: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances up to the distance at which ``wanted`` ids are reached; ties are all there."""
        n, m = len(self.codes), len(self.segments)
        spread = np.unpackbits(code.view(np.uint8), bitorder="little")[: self.bits].astype(np.int64)
        own = [int(spread[low:high] @ (1 << np.arange(high - low, dtype=np.int64))) for low, high, _, _ in self.segments]
        met = np.zeros(n, bool)
        per_distance = np.zeros(self.bits + 1, np.int64)
        rows, found = [], []

        def add(some: np.ndarray) -> None:
            some = some[~met[some]]
            met[some] = True
            distance = np.bitwise_count(self.codes[some] ^ code).sum(1, dtype=np.int64)
            np.add.at(per_distance, distance, self.weights[some])
            rows.append(some)
            found.append(distance)

        for radius in range(max(high - low for low, high, _, _ in self.segments) + 1):
            for j, (low, high, order, starts) in enumerate(self.segments):
                if radius <= high - low:
                    probes = own[j] ^ masks(high - low, radius)
                    if len(probes) > n:  # looking at every row is less work than going on probing
                        add(np.flatnonzero(~met))
                        return self._within(rows, found, per_distance, wanted)
                    begin, end = starts[probes], starts[probes + 1]
                    hit = end > begin
                    begin, size = begin[hit], (end - begin)[hit]
                    if len(size):
                        steps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        add(order[np.repeat(begin, size) + steps])
                covered = m * radius + j
                if per_distance[: covered + 1].sum() >= wanted:
                    return self._within(rows, found, per_distance, wanted)
        return self._within(rows, found, per_distance, wanted)

    def _within(self, rows, found, per_distance, wanted) -> tuple[np.ndarray, np.ndarray]:
        reached = int(np.searchsorted(np.cumsum(per_distance), wanted))
        rows, found = np.concatenate(rows), np.concatenate(found)
        near = found <= reached
        return rows[near], found[near]


def search_shard(shard: list[dict], queries: list[bytes], bits: int, options: SearchOptions):
    """Of each query code the k + 1 nearest ids of a shard: (query, distance, id)."""
    codes = np.frombuffer(b"".join(r["code"] for r in shard), np.uint64).reshape(len(shard), -1)
    ids = [r["ids"] for r in shard]
    index = MultiIndex(codes, np.array([len(i) for i in ids]), bits, options)
    for query in queries:
        rows, distances = index.search(np.frombuffer(query, np.uint64), options.k + 1)
        pairs = sorted((d, i) for r, d in zip(rows.tolist(), distances.tolist(), strict=True) for i in ids[r])
        yield from ((query, d, i) for d, i in pairs[: options.k + 1])


# --- Spark ----------------------------------------------------------------------------------------


def nearest(vectors: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest other rows of every query id."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    bits = max(int(longest), 1)
    code = sign_codes(F.col("embedding"), -(-bits // 64))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), code.alias("code"))
    coded = staged(rows.where("code is not null and vec_id is not null").distinct(), "codes")
    # the limit on ranks is applied in each task before rows of a code meet
    rank = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    distinct = (
        coded.withColumn("rank", rank).where(F.col("rank") <= options.k + 1)
        .groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    index = staged(distinct, "code-index")
    is_query = F.col("vec_id") % options.query_step == 0
    asked = coded.where(is_query)
    shards = max(1, -(-index.count() // options.shard_rows))
    codes_asked = asked.select("code").distinct()
    blocks = max(1, -(-codes_asked.count() // options.block_rows))
    by_hash = F.pmod(F.xxhash64("code"), F.lit(shards)).alias("shard")
    packed_rows = (
        index.groupBy(by_hash)
        .agg(F.collect_list(F.struct("code", "ids")).alias("rows"))  # shard_rows on average
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    )
    packed_queries = (
        codes_asked.groupBy(F.pmod(F.xxhash64(F.lit(3), F.col("code")), F.lit(blocks)).alias("block"))
        .agg(F.collect_list("code").alias("queries"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    )

    def search(batches):
        for batch in batches:
            for pair in batch.to_pylist():
                found = list(search_shard(pair["rows"], pair["queries"], bits, options))
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                kinds = (pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["code", "distance", "id"]
                )

    pairs = packed_rows.join(packed_queries, ["shard", "block"]).select("rows", "queries")
    found = pairs.repartition(shards * blocks).mapInArrow(search, "code binary, distance int, id bigint")
    order = F.row_number().over(Window.partitionBy("code").orderBy("distance", "id"))
    best = (
        found.withColumn("rank", order).where(F.col("rank") <= options.k + 1)
        .groupBy("code").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    )
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, options.k)
    return (
        asked.join(best, "code")
        .select("vec_id", F.posexplode(others).alias("position", "x"))
        .select(
            "vec_id", (F.col("position") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.col("x.distance").alias("distance")
        )
    )
