import numpy as np
from llm.conftest import rows_of

from drayline.llm import hamming_search as hs


def brute(vectors, k, bits):
    codes = {}
    for i, v in vectors:
        if i is not None and v is not None:
            codes[i] = [int(x is not None and x == x and x > 0) for x in v] + [0] * (bits - len(v))
    rows = []
    for q in (i for i in codes if i % 20 == 0):
        near = sorted((sum(a != b for a, b in zip(codes[q], c, strict=True)), i) for i, c in codes.items() if i != q)
        rows += [(q, rank + 1, i, d) for rank, (d, i) in enumerate(near[:k])]
    return sorted(rows, key=str)


def test_all_neighbours(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(40, 70))
    vectors = [(i, [float(x) for x in base[i % 40] + draw.normal(0, 0.3, 70)]) for i in range(600)]
    vectors += [(i, vectors[0][1]) for i in range(600, 680)]  # many copies of a query
    vectors += [(680, None), (None, vectors[1][1]), (700, [1.0, None, float("nan"), -1.0]), (5, vectors[5][1]), (720, [])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, code string")
    for options in (hs.SearchOptions(), hs.SearchOptions(k=3, shard_rows=100, block_rows=7, segment_bits=6)):
        assert rows_of(hs.nearest(df, options)) == brute(vectors, options.k, 70)
    assert hs.nearest(df.limit(0)).collect() == []


def test_few_rows(spark):
    vectors = [(0, [1.0, -1.0]), (1, [1.0, 1.0]), (20, [1.0, -1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert rows_of(hs.nearest(df)) == brute(vectors, 10, 2)
