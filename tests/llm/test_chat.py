import hashlib

import pytest

from drayline.llm import chat

NASTY = [
    "<|end|>\n", "<|turn:user|>", "<\\|x", "<\\\\|", "a<", "|b", "\\### Assistant: </turn> ok", "", "<|image|>", "\\", "<|" * 5,
]


def test_texts_come_back(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(NASTY)]
    rows += [(2, 1, "us|er<\\", None), (2, 0, None, "x"), (2, None, "assistant", "first"), (None, 0, "assistant", "lone")]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    turns = chat.formatted(chat.text_parts(df))
    for r in turns.collect():
        role, _ = chat.parse_turn(r["piece"])
        assert role == r["role"] and r["piece"].count("<|") == 2
    found = {r["conv_id"]: r for r in chat.read_conversations(turns).collect()}
    assert len(found) == 4
    for conv_id in found:
        mine = sorted(
            ((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv_id),
        )
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in mine).encode()).hexdigest()
        learned = "".join(x for *_, r, x in mine if r == "assistant")
        f = found[conv_id]
        assert (f["n_turns"], f["turns_sha256"]) == (len(mine), digest)
        assert (f["loss_chars"], f["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_conversations(turns.limit(0)).collect() == []


def test_parts_are_flattened(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    parts = [
        part("text", "a<"), part("text", "|b"), part("image", ref="i.png", w=100, h=57), None, part("text", "|<|image|>"),
        part("audio", ref="a.wav", s=2.5), part("document", ref="d.pdf", p=3),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    first, second = chat.formatted(df).orderBy("turn").collect()
    content = chat.TURN.fullmatch(first["piece"])[2]
    assert chat.parse_content(content) == [
        ("text", "a<|b"), ("image", ""), ("text", "|<|image|>"), ("audio", ""), ("document", ""),
    ]
    assert [tuple(a) for a in first["attachments"]] == [
        (0, "image", "i.png", 12), (1, "audio", "a.wav", 63), (2, "document", "d.pdf", 768),
    ]
    assert first["expanded_tokens"] == 843 and second["attachments"] == []
    bad = spark.createDataFrame([(1, 0, "user", [part("video")])], df.schema)
    with pytest.raises(Exception, match="unknown content part"):
        chat.formatted(bad).collect()
