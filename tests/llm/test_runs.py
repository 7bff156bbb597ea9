import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from drayline.llm import query_runs, runs


def brute(words, least=12):
    """All runs by looking at every period."""
    numbers = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    found = []
    for q in range(1, len(ids) // 2 + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for start, end in edges.tolist():
            length = end - start + q
            if length >= max(least, 2 * q):
                own = ids[start : start + length]
                if not any(q % d == 0 and (own[d:] == own[:-d]).all() for d in range(1, q)):
                    found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def found_in(texts, options=runs.RunOptions()):
    return [([tuple(r) for r in rows.tolist()], text) for rows, text in runs.runs_of_texts(texts, options)]


def check(texts, options=runs.RunOptions()):
    for text, (found, collapsed) in zip(texts, found_in(texts, options), strict=True):
        words = words_of(text)
        assert found == brute(words, options.least_words)
        assert collapsed == collapse(words, found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab c", max_size=160), max_size=4), st.integers(1, 14), st.sampled_from([5, 1 << 18]))
def test_short_alphabets(texts, least, group):
    check(texts, runs.RunOptions(least, group))


def test_drawn_texts():
    draw = np.random.default_rng(4)
    texts = []
    for size in (1, 2, 30, 300, 900):
        for letters in (1, 2, 3, 5, 40):
            words = draw.integers(0, letters, size).astype(str).tolist()
            at = int(draw.integers(size))
            texts += [" ".join(words), " ".join(words[: at + 7] * 3), " ".join((words[at:] + ["x"]) * 5 + words)]
    fib = ["a", "a b"]
    while len(fib) < 13:
        fib.append(f"{fib[-1]} {fib[-2]}")
    check([*texts, fib[-1], "", " \n", "say " * 500, ("a " * 20 + "b ") * 20])


def test_long_texts_stay_quick():
    some = " ".join(f"w{i % 50_000}" for i in range(200_000))
    assert found_in([some])[0][0] == [(0, 200_000, 50_000)]
    assert found_in(["a " * 200_000 + "b"])[0] == ([(0, 200_000, 1)], "a b")


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = rewritten(doc_id, words_of(text))
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *four, digest(lines), digest(collapse(words, found)))


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "odd"])
def test_query(spark, sf_dir, odd_documents, folder):
    if sf_dir == "odd":
        more = spark.createDataFrame([(d, "some few words to be made periodic " * 9) for d in range(20, 80)], "doc_id long, text string")
        sf_dir = str(folder)
        odd_documents.unionByName(more, allowMissingColumns=True).write.parquet(f"{sf_dir}/documents.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = query_runs.op12_runs(spark, sf_dir)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((expected(*d) for d in docs), key=str)


def test_columns_and_empty_tables(spark, odd_documents, no_documents):
    found = runs.with_runs(odd_documents.withColumn("runs", odd_documents["lang"]))
    assert found.columns == [*odd_documents.columns, "runs", "collapsed"] and found.count() == odd_documents.count()
    assert runs.with_runs(no_documents).collect() == []
