import hashlib
import re

import pytest

from drayline.llm import decontamination as dc


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    """Results by comparing every window of every item with every place of every text."""
    found = []
    for doc_id, text in docs:
        words, hit, owners = words_of(text), set(), set()
        for item_id, item in items:
            own = words_of(item)
            size = min(10, len(own))
            for k in range(len(own) - size + 1 if own else 0):
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == own[k : k + size]:
                        hit |= set(range(i, i + size))
                        owners.add("" if item_id is None else str(item_id))
        names = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        found.append((doc_id, len(words), len(hit), len(owners), names, bool(hit)))
    return sorted(found, key=str)


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
ITEMS = [(1, LONG), (2, LONG.upper()), (10, "one short ITEM"), (3, ""), (4, None), (5, "--- !!"), (None, "null id item"), (6, "x " * 14),
         (7, "été 漢字 été"), (10, "second text of ten")]
DOCS = [(1, f"before {LONG.replace(' ', ', ')} after"), (2, "BETA gamma delta epsilon zeta eta theta iota kappa Lambda"),
        (3, "alpha beta gamma delta epsilon zeta eta theta iota"), (4, None), (5, ""), (6, "x " * 40), (7, "One-short.item; one short item"),
        (8, "a NULL id item"), (9, "Été 漢字 été und été 漢字 été"), (9, "other text"), (9, "other text"), (None, "one short item"),
        (11, " ".join(f"w{i}" for i in range(30_000)) + f" {LONG} " + "y" * 100_000), (12, "second text of ten one short item")]
DOCS += [(100 + i, f"copy of a text with one short item and {LONG}") for i in range(60)]


@pytest.mark.parametrize("options", [dc.DecontaminationOptions(), dc.DecontaminationOptions(broadcast_windows=3, salts=3)])
def test_brute_force(spark, options):
    docs = spark.createDataFrame([(*r, 5, "z") for r in DOCS], "doc_id long, text string, n_words int, text_key string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = dc.contamination(docs, items, options)
    assert found.columns == ["doc_id", "text_key", *dc.ADDED]
    rows = [tuple(r) for r in found.drop("text_key").collect()]
    assert sorted(rows, key=str) == brute(DOCS, ITEMS)


def test_removal(spark):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(DOCS)], "doc_id long, text string, size int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {i for i, d in enumerate(DOCS) if brute([d], ITEMS)[0][-1]}
    kept = dc.clean_documents(docs, items).collect()
    assert {r["size"] for r in kept} == set(range(len(DOCS))) - bad
    assert all((r["doc_id"], r["text"]) == DOCS[r["size"]] for r in kept)
    cut = {r["size"]: r["text"] for r in dc.without_spans(docs, items).collect()}
    assert len(cut) == len(DOCS)
    for i, (doc_id, text) in enumerate(DOCS):
        if i not in bad:
            assert cut[i] == text
        else:
            _, n_words, n_hit, *_ = brute([(doc_id, text)], ITEMS)[0]
            assert len(words_of(cut[i])) == n_words - n_hit
    assert cut[0] == "before after" and cut[6] == "" and cut[8] == "Été 漢字 été und"


def test_empty_tables(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.contamination(no_documents, items).collect() == []
    clean = dc.contamination(odd_documents, none)
    assert clean.count() == odd_documents.count() and not clean.where("contaminated or n_hit > 0 or n_items > 0").count()
    assert dc.without_spans(odd_documents, none).columns == odd_documents.columns


def test_the_scan_stays_in_the_jvm(spark, odd_documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    windows = dc.item_windows(items, dc.DecontaminationOptions()).select("window", "size").distinct()
    plan = dc.hits(odd_documents, windows, dc.DecontaminationOptions())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("translate(coalesce(text") == 2  # once for the texts, once for the items
