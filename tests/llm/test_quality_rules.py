import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from drayline.llm import quality_rules as qr

BLANK = "\x20\x09-\x0d"


def brute(text):
    text = text or ""
    words = re.findall(f"[^{BLANK}]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(f"[^{BLANK}]", line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def test_counts_and_base_rule(spark, odd_documents):
    found = qr.judged(odd_documents.withColumn("lang", F.col("text"))).collect()
    assert len(found) == odd_documents.count()
    for r in found:
        assert tuple(r[c] for c in qr.COUNTS[:5]) + (r["base_failed"],) == brute(r["lang"])
        assert r["kept"] in (True, False) and not (r["kept"] and r["base_failed"])


def test_votes_are_weighed():
    patterns = np.array([[1] * 8, [-1, 1, 1, -1, 1, 1, 1, 1], [1, 1, 1, 1, 0, 1, 1, 1], [1, -1, 1, 1, 1, 1, 1, 1]])
    model = qr.fit_votes(patterns, np.array([900.0, 80, 19, 1]), qr.RuleOptions())
    gap = np.log(model.good_share / (1 - model.good_share)) + sum(
        np.log(model.good[j] / model.bad[j])[patterns[:, j] + 1] for j in range(8)
    )
    assert (gap > 0).tolist()[:3] == [True, False, True]
    assert model.bad[0, 0] > 0.8 > model.bad[1, 0]  # the first rule is found to be accurate


def test_labels_are_met(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = qr.judged(documents).drop("quality").join(labels, "doc_id").where("not base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in rows)


def test_filter_keeps_columns(spark, odd_documents, no_documents):
    kept = qr.keep_good(odd_documents)
    assert kept.columns == odd_documents.columns
    verdicts = sorted(str(r["doc_id"]) for r in qr.judged(odd_documents).collect() if r["kept"])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == verdicts and {r["kept"] for r in kept.collect()} <= {1}
    assert qr.keep_good(no_documents).collect() == []
