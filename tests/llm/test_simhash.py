import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from drayline.llm import simhash as sh


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def clustered(seed, rows):
    """Random fingerprints with chains and clouds of near ones."""
    draw = np.random.default_rng(seed)
    centres = draw.integers(0, 2**63, rows // 4, dtype=np.uint64)
    values = [int(x) for x in centres]
    while len(values) < rows:
        near = values[draw.integers(len(values))] if draw.random() < 0.3 else int(centres[0])
        for bit in draw.integers(0, 64, draw.integers(1, 4)):
            near ^= 1 << int(bit)
        values.append(near)
    return np.unique(np.array(values, np.uint64))


def test_shards_find_all_links():
    values = clustered(1, 1500)
    found, least = sh.shard_links(values, values[:0], sh.SimhashOptions(leaf_rows=8))
    roots = brute_components(values)
    grouped = {int(values[i]): int(values[r]) for i, r in enumerate(roots) if roots.count(r) > 1}
    assert dict(zip(found.tolist(), least.tolist(), strict=True)) == grouped


@pytest.mark.parametrize("options", [sh.SimhashOptions(), sh.SimhashOptions(shard_rows=40, block_rows=60, leaf_rows=8, sample_rows=300)])
def test_components_over_shards(spark, options):
    values = clustered(2, 900)
    rows = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values.view(np.int64))], "doc_id long, fp long")
    found = {r["fp"]: r["component_id"] for r in sh.class_ids(rows, options).collect()}
    roots = brute_components(values)
    assert found == {int(v): r for v, r in zip(values.view(np.int64), roots, strict=True)}


def test_documents(spark, odd_documents, no_documents):
    found = sh.near_duplicates(odd_documents.withColumn("lang", F.col("text"))).collect()
    assert len(found) == odd_documents.count()
    for r in found:
        assert r["fingerprint"] == format(brute_print(r["lang"]), "016x")
    by_id = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"]}
    assert by_id[1] == by_id[2] == 1 and by_id[3] == by_id[4] == by_id[5] == 3
    kept = sh.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    components = [r["component_id"] for r in found]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted({c or 0 for c in components})
    assert sh.near_duplicates(no_documents).collect() == [] and sh.one_of_each(no_documents).collect() == []


def test_the_sample_is_never_the_whole_set():
    options = sh.SimhashOptions()
    for rows in (0, 1, 8192, 8193, 9296, 100_000, 10**9):
        shards = -(-rows // options.shard_rows)
        size = sh.sample_size(rows, shards, options)
        assert size <= min(rows // 4, options.sample_rows) and (size == 0) == (shards < 2)
