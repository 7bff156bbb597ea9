import hashlib
import random
from collections import Counter, defaultdict

import pytest

from drayline.llm import mixing


def test_mix_and_documents_agree(spark, odd_documents, no_documents):
    taken = mixing.mix(odd_documents).collect()
    assert len(taken) == odd_documents.count()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in taken)
    total = sum(r["size"] for r in taken)
    targets = {r["source"]: r["target"] for r in taken}
    assert sum(r["taken"] for r in taken) <= 1.5 * total and abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    copies = mixing.mixed_documents(odd_documents)
    assert copies.columns == odd_documents.columns
    rows = copies.collect()
    assert len(rows) == sum(r["taken"] // r["size"] for r in taken if r["size"])
    assert mixing.mix(no_documents).collect() == [] and mixing.mixed_documents(no_documents).collect() == []


def test_targets_are_met_and_sliced_sums_are_the_same(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = sorted(map(tuple, mixing.mix(documents).select("doc_id", "taken").collect()))
    sliced = mixing.mix(documents, mixing.MixOptions(slice_rows=10)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in sliced) == plain
    got, target = defaultdict(int), {}
    for r in sliced:
        got[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(got[s] - target[s]) <= 50 for s in target)


def by_hand(rows, seed=17):
    """Words taken of every (doc_id, size, source) row: queue, finish times and budget in plain loops."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, t in rows if t == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    budget, free, target = 1.5 * sum(size.values()), set(sources), {}
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in over} if over else {s: weight[s] * level for s in free}
        free = free - over if over else set()
    copies = []
    for s in sources:
        queued = 0
        key = {i: hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest() for i, (d, _, _) in enumerate(rows)}
        mine = [i for i, r in enumerate(rows) if r[2] == s and r[1]]
        for i in sorted(mine, key=lambda i: (key[i], rows[i][0] is not None, rows[i][0] or 0, rows[i][1])):
            queued += rows[i][1]
            copies += [((e * size[s] + queued) / target[s], "" if s is None else f"s{s}", key[i], i) for e in (0, 1)]
    used, taken = 0, [0] * len(rows)
    for _, _, _, i in sorted(copies):
        used += rows[i][1]
        if used > budget:
            break
        taken[i] += rows[i][1]
    return sorted(((d, n, s, t) for (d, n, s), t in zip(rows, taken)), key=str)


@pytest.mark.parametrize("slice_rows", [40, 100_000])
def test_mix_by_hand_with_a_hot_id(spark, slice_rows):
    pick = random.Random(slice_rows)
    ids = [None if pick.random() < 0.3 else 5 if pick.random() < 0.3 else i for i in range(400)]
    rows = [(d, pick.choice([0, 1, 9, 40]), pick.choice(["a", "b", "b", "b", "b", "c", None])) for d in ids]
    texts = [(d, " ".join(["w"] * n), s) for d, n, s in rows]
    documents = spark.createDataFrame(texts, "doc_id long, text string, source string")
    options = mixing.MixOptions(slice_rows=slice_rows)
    got = mixing.mix(documents, options).select("doc_id", "size", "source", "taken").collect()
    expected = by_hand(rows)
    # rows alike in id, size and source are interchangeable
    assert sorted(map(tuple, got), key=str) == expected
    copies = Counter((r["doc_id"], len(r["text"].split()), r["source"]) for r in mixing.mixed_documents(documents, options).collect())
    wanted = Counter()
    for d, n, s, t in expected:
        wanted[d, n, s] += t // n if n else 0
    assert copies == +wanted


def test_range_sums(spark):
    rows = spark.range(1000).selectExpr("id % 3 as k", "id", "id % 7 as n")
    got = mixing.range_sums(rows, ["k", "id"], "n", 9, "test").orderBy("k", "id").collect()
    total = 0
    for r in got:
        total += r["n"]
        assert r["running"] == total
    assert len(got) == 1000
    assert mixing.range_sums(rows.where("id < 0"), ["k", "id"], "n", 1, "test").collect() == []


def test_clashing_and_extra_columns_are_kept_apart(spark):
    rows = [(i, "a b c", "s", "mine", "mine", {"k": i}) for i in range(9)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string, _row string, extra map<string,int>")
    got = mixing.mix(documents).collect()
    assert {r["_row"] for r in got} == {"mine"} and all(r["taken"] in (0, 3, 6) and r["extra"] == {"k": r["doc_id"]} for r in got)
    made = mixing.mixed_documents(documents)
    assert made.columns == documents.columns and {r["taken"] for r in made.collect()} == {"mine"}
