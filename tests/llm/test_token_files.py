import json
import random
import zlib

import numpy as np
import pytest

from drayline.llm import token_files as tf
from drayline.llm.bpe import ByteBpe, byte_bpe
from drayline.session import shared_dir


@pytest.mark.parametrize("n", [1, 63, 64, 1000, 70_000])
def test_coder_round_trip(n):
    tokens = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype(np.uint32)
    symbols, counts = np.unique(tokens, return_counts=True)
    coder = tf.Coder(tf.Table.from_bytes(tf.Table.of(symbols, counts).to_bytes()))
    raw = coder.encode(tokens, tf.TokenFileOptions(lanes=32, checkpoint_steps=8))
    assert np.array_equal(coder.decode(raw), tokens)
    for begin, end in [(0, 1), (n // 3, n // 2), (n - 1, n), (n // 2, n)]:
        assert np.array_equal(coder.decode(raw, begin, end), tokens[begin:end])


def test_damage_is_noticed():
    raw = tf.Table.of(np.array([1, 2]), np.array([3, 4])).to_bytes()
    with pytest.raises(ValueError):
        tf.Table.from_bytes(raw[:-5] + bytes([raw[-5] ^ 1]) + raw[-4:])


def expected(documents):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tf.tokenizer_path(tf.TokenFileOptions()))
    rows = []
    for r in documents.collect():
        ids = np.array([*tool.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        rows.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    return rows


@pytest.mark.parametrize("block", [64, 1 << 18])
def test_documents_come_back(spark, odd_documents, block):
    folder = shared_dir(spark, "test-tokens")
    options = tf.TokenFileOptions(block_tokens=block, lanes=8, checkpoint_steps=4)
    tf.write_tokens(odd_documents, folder, options)
    found = sorted(tf.read_tokens(spark, folder, with_ids=True, unit_blocks=2).collect(), key=lambda r: r["start"])
    assert sorted(((r[0], r[2], r[3]) for r in found), key=str) == sorted(expected(odd_documents), key=str)
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in found)


def test_empty_table(spark, no_documents):
    folder = shared_dir(spark, "test-tokens")
    tf.write_tokens(no_documents, folder)
    assert tf.read_tokens(spark, folder).collect() == []


def test_words_are_encoded_as_the_library_does():
    tool = byte_bpe(tf.tokenizer_path(tf.TokenFileOptions()))
    texts = [f"{chr(c)} {chr(c)}a{chr(c)}1 {chr(c)}{chr(c)}" for c in range(1, 0x3A0) if not 0xD800 <= c < 0xE000]
    texts += ["it's we'll  x  \n\n y\t", " lead", "trail ", "a<|endoftext|> b", "  x", "Привет"]
    direct = tool.library.encode_batch(texts, add_special_tokens=False)
    assert tool.encode(texts) == [np.array(e.ids, tool.kind).tobytes() for e in direct]


def test_new_words_are_merged_by_the_model_alone(monkeypatch):
    """The library's whole pipeline was run again over new words; it is for texts that can't be split here only."""
    path = tf.tokenizer_path(tf.TokenFileOptions())
    tool = ByteBpe(path, 1 << 20, False)
    texts = ["don't  stop\n\n 123 été naïve ÿ\x00\x7f\xad\x85 ŝœ", "", "\t\t a" + "xy" * 50]
    expected = [tool.library.encode(t, add_special_tokens=False).ids for t in texts]
    given = []
    raw = tool._raw
    monkeypatch.setattr(tool, "_raw", lambda some: given.extend(some) or raw(some))
    assert [np.frombuffer(x, tool.kind).tolist() for x in tool.encode(texts)] == expected and not given


def as_the_library(tool, texts):
    direct = tool.library.encode_batch(texts, add_special_tokens=False)
    return tool.encode(texts) == [np.array(e.ids, tool.kind).tobytes() for e in direct]


def test_new_words_are_merged_many_at_a_time(monkeypatch):
    """The model was called once for each new word."""
    tool = ByteBpe(tf.tokenizer_path(tf.TokenFileOptions()), 1 << 24, False)
    merged, calls = tool._merged, []
    monkeypatch.setattr(tool, "_merged", lambda spelt: calls.append(spelt) or merged(spelt))
    letters = "abcdefghiéß"
    texts = [" ".join(a + b + c + d for b in letters for c in letters for d in letters) for a in letters]
    assert as_the_library(tool, texts)
    assert 0 < len(calls) <= len(tool.young) // 256 + 1
    calls.clear()
    assert as_the_library(tool, texts) and not calls


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("remembered", [1000, 1 << 20])  # 1000: forgotten all the time
def test_odd_texts_are_cut_as_the_library_does(plain, remembered):
    tool = ByteBpe(tf.tokenizer_path(tf.TokenFileOptions()), remembered, plain)
    signs = [*"''''  \n\t\r\x0b\x0c\x1c\x00\x7f\x85\xa0\xadabstdmlvreSL09½²éßÿŝʰ̀̿!.|<"]
    signs += ["'s", "'ll", "'ve", "'re", "''s", "  "]
    others = ["̀", "ͯ", "Ͱ", "Ω", "<|endoftext|>", "日本", "\U0001f600"]
    draw = random.Random(3)
    for k in range(40):
        chosen = signs + others * (k % 2)
        assert as_the_library(tool, ["".join(draw.choices(chosen, k=draw.randrange(14))) for _ in range(100)])


@pytest.mark.parametrize("change", ["ignore_merges", "sign"])
def test_models_whose_words_do_not_part_take_whole_texts(tmp_path, change):
    """Words are merged in one string only if the model comes out with each word's own ids."""
    with open(tf.tokenizer_path(tf.TokenFileOptions()), encoding="utf-8") as file:
        settings = json.load(file)
    model = settings["model"]
    new = max(model["vocab"].values()) + 1
    if change == "sign":  # of the byte between words
        model["merges"].insert(0, ["a", "ÿ"])
        model["vocab"]["aÿ"] = new
    else:
        model["ignore_merges"] = True
        model["vocab"]["Ġzqzqzq"] = new
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(settings))
    assert as_the_library(ByteBpe(str(path), 1 << 20, False), ["a zqzqzq banana", "", "a a"])


def test_long_texts_and_words_go_piece_by_piece(monkeypatch):
    """A word of any length came into one string with 255 others; places of a whole text were held at once."""
    from drayline.llm import bpe

    monkeypatch.setattr(bpe, "PIECE_BYTES", 3)
    monkeypatch.setattr(bpe, "PARTED_BYTES", 8)
    tool = ByteBpe(tf.tokenizer_path(tf.TokenFileOptions()), 1 << 20, False)
    merged, given = tool._merged, []
    monkeypatch.setattr(tool, "_merged", lambda spelt: given.append(spelt) or merged(spelt))
    texts = ["é" * 40 + " naïveté déjà-vu it's " + "ab" * 30, "ŝ" * 7, " " * 50 + "x"]
    assert as_the_library(tool, texts)
    assert given and max(len(word) for spelt in given for word in spelt.split("ÿ")) <= 8
