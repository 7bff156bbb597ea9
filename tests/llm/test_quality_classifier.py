import zlib

import numpy as np

from drayline.llm import quality_classifier as qc
from drayline.llm import queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    queries.load_all()
    rows = queries.QUERIES["op8_quality_classifier"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_descent_solves_the_hinge_problem():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([1, 3]), np.array([2, 3])]
    signs = np.array([1.0, 1, -1, -1])
    options = qc.ClassifierOptions(passes=500)
    ratios = np.array([1.0, 0.5, 0.5, -1.0])
    weights, bias = qc.dual_descent(rows, signs, ratios, options)

    def loss(w, b):
        total = (w @ w + b * b) / 2
        for r, y in zip(rows, signs, strict=True):
            x = ratios[r] / np.linalg.norm(ratios[r])
            total += max(0, 1 - y * (w[r] @ x + b))
        return total

    best, draw = loss(weights, bias), np.random.default_rng(0)
    assert all(loss(weights + draw.normal(0, 0.05, 4), bias + draw.normal(0, 0.05)) >= best - 1e-3 for _ in range(300))


def test_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, 1), (7, 0), (12, 0), (4, None), (6, 1), (None, 0)], "doc_id long, quality int")
    model = qc.train(odd_documents, labels)
    found = qc.scored(odd_documents, model).collect()
    assert len(found) == odd_documents.count()
    for r in found:
        crc = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == crc and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert qc.keep_predicted(odd_documents, model).columns == odd_documents.columns
    assert qc.scored(no_documents, model).collect() == []
    nothing = qc.train(odd_documents, labels.limit(0))
    assert {r["score"] for r in qc.scored(odd_documents, nothing).collect()} == {0.5}
