"""SimHash near-duplicates by vantage-point trees.

Fingerprints: a text is lower-cased (A-Z), its 3-word shingles are hashed with XXH64 (seed 42), and a
bit of the fingerprint is 1 if it is set in over half of the hashes.

Search: a vantage-point tree over a bounded sample of fingerprints cuts the space into shards. A node
sends the fingerprints within its radius to one side, the others to the other side; by the triangle
inequality a fingerprint within ``distance`` of the border may have partners on both sides, so it is
also sent as a visitor to the side it isn't at home in. Inside a shard the same tree goes on down to
small leaves, which are compared exactly. Every pair is found: two fingerprints at home in different
shards meet where one of them visits the other.

What leaves a shard is one row per fingerprint that has a partner, naming the least fingerprint it is
connected to there, not the pairs: a group of many near copies stays linear. Connected components are
then found over these rows by alternating large-star and small-star rounds, each written to the shared
folder.

Copies of one fingerprint are one row from the start. A shard with more than ``block_rows`` rows at home is
compared block by block, each pair of blocks in a task of its own, so no group grows without bound.

Defined cases: NULL and empty texts have fingerprint 0 and link like any other; a text with fewer
than three words is one shingle; equal texts, repeated rows and ties fall into one component; NULL ids
are ignored as representatives unless a component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drayline.llm.base import column_udf, staged, texts_of

SEED = 42
#: Sampled fingerprints of a shard.
SHARD_SAMPLE = 256


@dataclass(frozen=True)
class SimhashOptions:
    words: int = 3  # of a shingle
    distance: int = 2  # differing bits of linked fingerprints
    shard_rows: int = 8192  # fingerprints at home in a shard, on average
    sample_rows: int = 1 << 17  # fingerprints that the tree of shards is built from, at most
    block_rows: int = 32768  # rows of a shard compared in one task, at most
    leaf_rows: int = 256  # a shard's own tree ends at so many rows


# --- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle, in the order of the text, as unsigned numbers."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
    if not found:
        return np.empty(0, "<u8")
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")


def fingerprint(text: str, words: int) -> int:
    """The fingerprint as an unsigned number; 0 without a word."""
    hashes = shingle_hashes(text, words)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprint_of(text: Column, options: SimhashOptions = SimhashOptions()) -> Column:
    """The fingerprint as a signed 64-bit number with the same bits."""

    def run(texts: pa.Array) -> pa.Array:
        values = [fingerprint(t, options.words) for t in texts_of(texts)]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return column_udf(run, "bigint")(text)


# --- the tree of shards ---------------------------------------------------------------------------


def distances(values: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(values ^ vantage).astype(np.int64)


def choose_vantage(values: np.ndarray) -> tuple[np.uint64, int] | None:
    """Of some candidates the vantage point and radius that leave the least on both sides at once.

    The cost of a cut is the share of rows near the border against how evenly it cuts.
    """
    best = None
    for i in np.linspace(0, len(values) - 1, 8).astype(int):
        d = np.sort(distances(values, values[i]))
        for q in (0.3, 0.5, 0.7):
            radius = int(d[int(q * (len(d) - 1))])
            inside = int(np.searchsorted(d, radius, "right"))
            if inside == len(d):
                continue
            near = np.searchsorted(d, radius + 2, "right") - np.searchsorted(d, radius - 2, "left")
            p = inside / len(d)
            bits = -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
            cost = np.log2(1 + near / len(d)) / bits
            if best is None or cost < best[0]:
                best = (cost, values[i], radius)
    return best and best[1:]


@dataclass(frozen=True)
class ShardTree:
    """Nodes as arrays: vantage point, radius, child within it and beyond it; a child below 0 is shard ~child."""

    vantage: np.ndarray
    radius: np.ndarray
    within: np.ndarray
    beyond: np.ndarray
    shards: int

    @staticmethod
    def build(sample: np.ndarray, shards: int) -> ShardTree:
        """Cut the sample until each part holds its share of ``shards``."""
        least = max(32, len(sample) // max(shards, 1))
        nodes: list[list] = []
        ends = 0

        def place(parent: int | None, side: int, child: int) -> None:
            if parent is not None:
                nodes[parent][side] = child

        todo = [(np.sort(sample), None, 0)]
        while todo:
            values, parent, side = todo.pop()
            cut = choose_vantage(values) if len(values) > least else None
            if cut is None:
                place(parent, side, ~ends)
                ends += 1
                continue
            vantage, radius = cut
            place(parent, side, len(nodes))
            near = distances(values, vantage) <= radius
            nodes.append([vantage, radius, 0, 0])
            todo += [(values[near], len(nodes) - 1, 2), (values[~near], len(nodes) - 1, 3)]
        columns = list(zip(*nodes, strict=True)) or [[], [], [], []]
        kinds = (np.uint64, np.int64, np.int64, np.int64)
        return ShardTree(*(np.array(c, dtype=k) for c, k in zip(columns, kinds, strict=True)), ends)

    def route(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of a value, shard, and whether it is at home there, for every shard a value goes to."""
        found = []
        todo = [(0 if len(self.vantage) else ~0, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            node, index, home = todo.pop()
            if not len(index):
                continue
            if node < 0:
                found.append((index, np.full(len(index), ~node), home))
                continue
            d, radius = distances(values[index], self.vantage[node]), self.radius[node]
            inside = d <= radius
            to_within, to_beyond = d <= radius + reach, d > radius - reach
            todo.append((int(self.within[node]), index[to_within], (home & inside)[to_within]))
            todo.append((int(self.beyond[node]), index[to_beyond], (home & ~inside)[to_beyond]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# --- links inside a shard -------------------------------------------------------------------------


class Links:
    """Union-find over positions of an array, least root first."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if np.array_equal(above, self.parent):
                return self.parent
            self.parent = above

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link a[i] with b[i] for all i."""
        while len(a):
            roots = self.roots()
            x, y = roots[a], roots[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if len(a):
                np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def link_near(left: np.ndarray, right: np.ndarray, values: np.ndarray, links: Links, options: SimhashOptions) -> None:
    """Link all positions of ``left`` and ``right`` whose values differ in at most ``distance`` bits."""
    reach = options.distance
    todo = [(left, right)]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        cut = None
        if len(a) > options.leaf_rows and len(b) > 16:
            step = max(1, len(a) // 512)
            cut = choose_vantage(np.sort(values[a[::step]]))
        if cut is not None:
            vantage, radius = cut
            da, db = distances(values[a], vantage), distances(values[b], vantage)
            inner, outer = da <= radius, da > radius
            near, far = db <= radius + reach, db > radius - reach
            size = inner.sum() * near.sum() + outer.sum() * far.sum()
            if size < 0.9 * len(a) * len(b):
                todo += [(a[inner], b[near]), (a[outer], b[far])]
                continue
        step = max(1, (1 << 21) // len(b))
        for start in range(0, len(a), step):
            rows = a[start : start + step]
            i, j = np.nonzero(np.bitwise_count(values[rows][:, None] ^ values[b][None, :]) <= reach)
            links.add(rows[i], b[j])


def shard_links(home: np.ndarray, guests: np.ndarray, options: SimhashOptions) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted fingerprints at home and guests: those with a partner, and the least one of their group."""
    values = np.unique(np.concatenate([home, guests]))
    links = Links(len(values))
    at_home = np.searchsorted(values, home)
    link_near(at_home, np.arange(len(values)), values, links, options)
    roots = links.roots()
    grouped = np.bincount(roots, minlength=len(values))[roots] > 1
    return values[grouped], values[roots[grouped]]


# --- Spark ----------------------------------------------------------------------------------------


def sample_size(rows: int, shards: int, options: SimhashOptions) -> int:
    """Fingerprints the tree is built from: some for each shard, none for one shard, never the whole set."""
    return 0 if shards < 2 else min(options.sample_rows, SHARD_SAMPLE * shards, rows // 4)


def near_links(fingerprints: DataFrame, options: SimhashOptions) -> DataFrame:
    """Rows (fp, least) joining every group of near fingerprints. Input: distinct fingerprints, column fp."""
    rows = fingerprints.count()
    mixed = F.xxhash64(F.col("fp"))
    shards = -(-rows // options.shard_rows)
    wanted = sample_size(rows, shards, options)
    sample = np.empty(0, np.int64)
    if wanted:
        sample = fingerprints.orderBy(mixed, "fp").limit(wanted).toPandas()["fp"].to_numpy(np.int64)
    tree = ShardTree.build(sample.view(np.uint64), shards)
    reach, block_rows = options.distance, options.block_rows

    def route(batches):
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            index, shard, home = tree.route(signed.view(np.uint64), reach)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed[index]), pa.array(shard, pa.int64()), pa.array(home)], ["fp", "shard", "home"]
            )

    routed = staged(fingerprints.mapInArrow(route, "fp bigint, shard bigint, home boolean"), "simhash-shards")
    # one row per shard, and a tree has at most sample_rows / 32 shards
    crowded = {
        r["shard"]: -(-r["n"] // block_rows)
        for r in routed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).collect()
    }
    blocks = F.lit(1)
    if crowded:
        known = F.create_map(*(F.lit(x) for pair in crowded.items() for x in pair))
        blocks = F.coalesce(known[F.col("shard")], F.lit(1))
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), blocks).cast("int")
    # a pair of blocks (i, j) gets the rows at home in block i, and all rows of block j as guests
    every = F.sequence(F.lit(0), blocks - 1)
    as_home = routed.where("home").select(
        "fp", "shard", own.alias("i"), F.explode(every).alias("j"), F.lit(True).alias("home")
    )
    as_guest = routed.select("fp", "shard", F.explode(every).alias("i"), own.alias("j"), F.lit(False).alias("home"))
    if not crowded:  # each row is in its shard's only block already
        dealt = routed.select("fp", "shard", F.lit(0).alias("i"), F.lit(0).alias("j"), "home")
    else:
        dealt = as_home.unionByName(as_guest)

    def link(group: pd.DataFrame) -> pd.DataFrame:
        values, home = group["fp"].to_numpy(np.int64).view(np.uint64), group["home"].to_numpy(bool)
        found, least = shard_links(np.unique(values[home]), np.unique(values[~home]), options)
        return pd.DataFrame({"fp": found.view(np.int64), "least": least.view(np.int64)})

    return dealt.groupBy("shard", "i", "j").applyInPandas(link, "fp bigint, least bigint")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): the least node each node of the links is connected to.

    Large-star and small-star rounds: every node's neighbours are hung below the least of them. The
    least neighbour is an aggregate, so a node with many neighbours isn't gathered anywhere; the join
    that follows may be split where one node has many links.
    """

    def hang(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not larger:
            both = edges.where("v < u").unionByName(edges.where("u < v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        joined = both.join(least, "u")
        moved = joined.where("v > u" if larger else "v <= u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not larger:
            moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    edges = staged(links.toDF("u", "v").where("u <> v").distinct(), "components")
    state = None
    for _ in range(most_rounds):
        edges = staged(hang(hang(edges, True), False), "components")
        mark = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")
        ).first()
        if mark == state:
            break
        state = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def class_ids(fingerprinted: DataFrame, options: SimhashOptions = SimhashOptions()) -> DataFrame:
    """(fp, root, component_id) per distinct fingerprint. Input: doc_id and fp of all documents."""
    distinct = staged(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = components(near_links(distinct.select("fp"), options))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, options: SimhashOptions = SimhashOptions()) -> DataFrame:
    """The input's rows, without text, with fingerprint (16 hex digits) and component_id (least id reachable)."""
    added = {"text", "fp", "root", "fingerprint", "component_id"}
    fp = fingerprint_of(F.col("text"), options).alias("fp")
    marked = staged(df.select(*(c for c in df.columns if c not in added), fp), "simhash-documents")
    classes = class_ids(marked.select("doc_id", "fp"), options)
    hex_digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(classes, "fp").withColumn("fingerprint", hex_digits).drop("fp", "root")


def one_of_each(df: DataFrame, options: SimhashOptions = SimhashOptions()) -> DataFrame:
    """One document of each component, the one with the least id, with the input's columns.

    Decisions are made on ids and fingerprints alone; texts are shuffled once, to meet them.
    """
    own = {c: f"_own_{i}" for i, c in enumerate(df.columns) if c in ("fp", "root", "component_id", "copy", "id_key")}
    rows = reduce(lambda d, c: d.withColumnRenamed(c, own[c]), own, df)
    narrow = df.select("doc_id", fingerprint_of(F.col("text"), options).alias("fp"))
    marked = staged(narrow, "simhash-documents")
    classes = class_ids(marked, options)
    # per component one fingerprint of its least id: a component is asked for one row only
    heads = (
        marked.join(classes, "fp")
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "component_id")
        .agg(F.min("fp").alias("fp"))
        .select("fp", id_key("component_id"))
    )
    keyed = rows.withColumn("fp", fingerprint_of(F.col("text"), options)).withColumn("id_key", id_key("doc_id"))
    met = keyed.join(heads, ["fp", "id_key"])
    # only repeated rows with the least id are left to choose from; they are together already
    copy = F.row_number().over(Window.partitionBy("fp", "id_key").orderBy("text"))
    return met.withColumn("copy", copy).where("copy = 1").select(*(F.col(own.get(c, c)).alias(c) for c in df.columns))


def id_key(column: str) -> Column:
    """An id as text, NULL as an empty one: joins compare it plainly."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("id_key")
