import random

import pytest
from pyspark.sql import functions as F

from drayline.llm import segmentation as sg

OPTIONS = sg.SegmentOptions()


@pytest.fixture(scope="module")
def tool():
    return sg.segmenter(sg.model_path(OPTIONS), 100)


def all_paths(tool, text):
    text, found = sg.BLANK + text.replace(" ", sg.BLANK), []

    def go(at, ids, score):
        if at == len(text):
            found.append((score, ids))
            return
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in tool.pieces:
                number, own = tool.pieces[text[at:end]]
                go(end, ids + number.to_bytes(4, "little"), score + own)
        if text[at] not in tool.pieces:
            go(at + 1, ids + tool.bytes_of(text[at]), score + tool.unknown)

    go(0, b"", 0.0)
    return sorted(found, key=lambda x: -x[0])


def test_best_paths_are_those_of_a_full_search(tool):
    draw = random.Random(3)
    for _ in range(150):
        text = "".join(draw.choice("the an\nin é漢☃o") for _ in range(draw.randint(1, 10)))
        every = all_paths(tool, text)
        for paths in (1, 2, 4, 7):
            found = tool.encode(text, paths)
            assert [s for s, _ in found] == [s for s, _ in every[:paths]]
            assert len({i for _, i in found}) == len(found) and {i for _, i in found} <= {i for _, i in every}
            assert all(tool.decode(i) == text for _, i in found)


def test_every_text_decodes(spark, odd_documents):
    rows = odd_documents.withColumn("n_pieces", F.lit("clash"))
    found = sg.with_segments(rows).withColumn("back", sg.decoded(F.col("piece_ids"))).collect()
    assert len(found) == rows.count() and all(r["back"] == (r["text"] or "") for r in found)
    assert {r["n_pieces"] for r in found if not r["text"]} == {0}
    summary = odd_documents.select(sg.segmentation_summary(F.col("text")).alias("s")).select("s.*").collect()
    assert all(r["decodes"] for r in summary)


def test_empty_table(spark, no_documents):
    assert sg.with_segments(no_documents).collect() == []


def test_two_best_is_the_search_for_two():
    import random

    from drayline.llm import segmentation as sg

    tool, draw = sg.Segmenter(sg.model_path(sg.SegmentOptions()), 1 << 20), random.Random(5)
    for _ in range(400):
        text = "▁" * draw.randint(0, 2) + "".join(draw.choices("etaoinshr漢é☃ \n.", k=draw.randint(1, 14)))
        (score, ids), *second = tool.search(text, 2)
        assert tool.two_best(text) == (ids, score, score - second[0][0] if second else -sg.NEVER)


def test_remembered_bytes_are_bounded():
    from drayline.llm import segmentation as sg

    tool = sg.Segmenter(sg.model_path(sg.SegmentOptions()), 100_000)
    free = sg.Segmenter(sg.model_path(sg.SegmentOptions()), 1 << 30)
    for part in range(20):
        text = " ".join(f"w{part}x{i}" for i in range(500)) + "漢" * 3000
        assert tool.encode(text, 3) == free.encode(text, 3)
        assert len(tool.young) + len(tool.old) < 2 * 500


def test_stretches_together_are_those_one_by_one():
    """Arrays give the ids, scores and losses of the plain pass, also for ties, unknown characters and long stretches."""
    tool, draw = sg.Segmenter(sg.model_path(OPTIONS), 1 << 20), random.Random(11)
    texts = {
        "▁" * draw.randint(0, 3) + "".join(draw.choices("etaoinshr漢é☃\n.!AZ0", k=draw.randint(1, 60))) for _ in range(3000)
    }
    texts |= {"\ud800", "▁", "▁▁▁▁", "a", "☃", "the" * 5000}
    texts = sorted(texts)
    assert tool.two_best_of(texts) == [tool.two_best(t) for t in texts]
    assert tool.two_best_of([]) == [] and tool.two_best_of(["☃"]) == [tool.two_best("☃")]


def test_texts_together_are_those_one_by_one(monkeypatch):
    monkeypatch.setattr(sg, "GROUP_CHARS", 300)
    monkeypatch.setattr(sg, "PASS_CHARS", 50)
    tool, draw = sg.Segmenter(sg.model_path(OPTIONS), 20_000), random.Random(12)
    texts = ["", "▁", "a▁▁b ▁", "\ud800 x"] + [
        " ".join("".join(draw.choices("etaoin☃漢▁\n", k=draw.randint(0, 9))) for _ in range(draw.randint(0, 40))) for _ in range(200)
    ]
    together = list(tool.encode_all(texts, 4))
    assert together == [sg.Segmenter(sg.model_path(OPTIONS), 1 << 20).encode(t, 4) for t in texts[:20]] + together[20:]
    assert together == [tool.encode(t, 4) for t in texts] and all(tool.decode(f[0][1]) == t for f, t in zip(together, texts))
