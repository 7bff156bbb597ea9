"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

Texts are cut into words as arrays of bytes, many texts at once; new words are merged by the tokenizer's model in
long strings, parted by the sign of a byte that no UTF-8 text has and no merge of the model touches.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Below this character the classes of letters, numbers and blanks have long been settled in Unicode; texts
#: with others go to the library whole. In UTF-8 its first byte tells it from those below.
PLAIN_END, PLAIN_LEAD = 0x340, 0xCD
GROUP_CHARS = 1 << 21
#: What a remembered word takes: dictionary slots, heads of word and ids, and up to LONG_WORD bytes.
ENTRY_BYTES, LONG_WORD = 200, 16
LETTER, NUMBER, BLANK, OTHER = range(4)
PART_BYTE, PARTED_WORDS = 0xFF, 256  # the byte between words merged together, and how many are
PARTED_BYTES = 1 << 12  # longer words are merged alone
PIECE_BYTES = 1 << 22  # of a long text whose places are held at once


def _byte_signs() -> np.ndarray:
    """The characters that stand for bytes in byte-level BPE: printable ones for themselves, others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return np.array([b if b in plain else next(others) for b in range(256)], "<u2")


def _classes() -> np.ndarray:
    """The class of each plain character."""
    kinds = {"L": LETTER, "N": NUMBER}
    classes = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(PLAIN_END)], np.uint8)
    classes[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = BLANK
    return classes


BYTE_SIGNS, CLASSES = _byte_signs(), _classes()


def word_starts(data: bytes, texts: np.ndarray) -> np.ndarray:
    """Where the words of byte-level BPE begin in the UTF-8 of plain texts, which begin at ``texts``.

    Words are contractions, letters, numbers or others, each with a space before them if there is one, and blanks.
    """
    n = len(data)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)  # so that three bytes follow each
    kind = CLASSES.take(raw)
    for at in range(0, n, PIECE_BYTES):
        lead = np.flatnonzero(raw[at : at + PIECE_BYTES] >= 0xC0) + at  # all of two bytes
        kind[lead] = kind[lead + 1] = CLASSES[((raw[lead] & 0x1F).astype(np.intp) << 6) | (raw[lead + 1] & 0x3F)]
    fresh = np.zeros(n + 3, bool)
    fresh[texts] = fresh[n] = True
    begins = fresh.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # the last blank before a word parts from other blanks, and joins the word if it is a space
    blank = kind == BLANK
    after = np.flatnonzero(blank[:-1] & ~blank[1:] & ~fresh[1:]) + 1
    last = after - 1 - (raw[after - 1] >= 0x80)
    begins[last] = True
    begins[after[raw[last] == 0x20]] = False
    # an apostrophe alone takes s, d, m, t, ll, ve or re from the letters after it
    quote = np.flatnonzero((raw[:n] == 0x27) & begins[:n])
    quote = quote[(kind[quote + 1] == LETTER) & ~fresh[quote + 1]]
    first, second = raw[quote + 1], np.where(fresh[quote + 2], 0, raw[quote + 2])
    one = np.isin(first, list(b"sdmt"))
    two = np.zeros(len(quote), bool)
    for a, b in (b"ll", b"ve", b"re"):
        two |= (first == a) & (second == b)
    begins[quote[one | two] + 1] = False
    begins[quote[one] + 2] = True
    begins[quote[two] + 3] = True
    return np.flatnonzero(begins[:n])


def _values(column: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a column without NULLs, some times faster than by its scalars."""
    _, places, raw = column.buffers()
    ends = np.frombuffer(places, np.int64, len(column) + 1, 8 * column.offset).tolist()
    raw = raw.to_pybytes()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _spelt(raw: bytes) -> str:
    return BYTE_SIGNS[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le")


class ByteBpe:
    """Encodes texts with one tokenizer file.

    Special tokens' strings in a text become their ids, as in the library, unless ``plain`` says that they are
    ordinary text.
    """

    def __init__(self, path: str, remembered: int, plain: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        split, model = settings["pre_tokenizer"] or {}, settings["model"]
        sign = chr(BYTE_SIGNS[PART_BYTE])
        self.by_words = (
            settings["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex")
            and not split.get("add_prefix_space")
            and model["type"] == "BPE"
            # and words merged in one string come out as each alone
            and not (model.get("dropout") or model.get("ignore_merges"))
            and not (model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
            and all(chr(s) in model["vocab"] for s in BYTE_SIGNS)
            and not any(sign in "".join(merge) for merge in model["merges"])
        )
        self.merger = Tokenizer(self.library.model)  # the model alone
        self.part = self.library.token_to_id(sign)
        self.special = [] if plain else [t["content"] for t in settings["added_tokens"]]
        self.size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.remembered = remembered
        # two generations: words met again move to the young one, and the old one is dropped when that is full
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0  # bytes of the young one

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, self.kind) for one in found]

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words. Each is a piece of its own after the split: the model merges it without a pipeline."""
        part, width, merged = bytes([PART_BYTE]), self.kind.itemsize, self.library.model.tokenize
        long = [word for word in words if len(word) > PARTED_BYTES]
        for word in long:
            self.young[word] = np.fromiter((t.id for t in merged(_spelt(word))), self.kind).tobytes()
        short = [word for word in words if len(word) <= PARTED_BYTES] if long else words
        for start in range(0, len(short), PARTED_WORDS):
            some = short[start : start + PARTED_WORDS]
            ids = self._merged(_spelt(part.join([*some, b""])))
            raw, before = ids.tobytes(), 0
            for word, end in zip(some, (np.flatnonzero(ids == self.part) * width).tolist(), strict=True):
                self.young[word] = raw[before:end]
                before = end + width

    def _merged(self, spelt: str) -> np.ndarray:
        return np.array(self.merger.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, self.kind)

    def _remember(self, words: list[bytes]) -> list[bytes]:
        """Bring words into the young memory; their ids."""
        if self.held >= self.remembered:
            self.old, self.young, self.held = self.young, {}, 0
        young, old, new = self.young, self.old, []
        before = len(young)
        found = list(map(young.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for word in map(words.__getitem__, missing):
            known = old.get(word)
            if known is None:
                new.append(word)
            else:
                young[word] = known
        if new:
            self._learn(new)
        for i in missing:
            found[i] = young[words[i]]
        # blanks of a long line and other long words count by their length, all others by what an entry takes
        long = sum(4 * len(words[i]) for i in missing if len(words[i]) > LONG_WORD)
        self.held += (len(young) - before) * ENTRY_BYTES + long
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of ``kind``."""
        results: list[bytes] = []
        start = 0
        while start < len(texts):  # some texts at a time, so that their new words are learned together
            end, chars = start, 0
            while end < len(texts) and chars < GROUP_CHARS:
                chars += len(texts[end])
                end += 1
            results += self._encode_group(texts[start:end])
            start = end
        return results

    def _is_whole(self, text: str, raw: bytes) -> bool:
        """Whether a text goes to the library whole."""
        if not self.by_words or any(s in text for s in self.special):
            return True
        return not text.isascii() and int(np.frombuffer(raw, np.uint8).max()) >= PLAIN_LEAD

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        raws = [t.encode() for t in texts]
        whole = [i for i, t in enumerate(texts) if self._is_whole(t, raws[i])]
        by_library = set(whole)
        split = [i for i in range(len(texts)) if i not in by_library]
        results = [b""] * len(texts)
        for i, ids in zip(split, self._by_words([raws[i] for i in split]), strict=True):
            results[i] = ids
        for i, ids in zip(whole, self._raw([texts[i] for i in whole]), strict=True):
            results[i] = ids.tobytes()
        return results

    def _by_words(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain texts: cut into words, distinct ones looked up, their ids put where the words were."""
        data = b"".join(texts)
        if not data:
            return [b""] * len(texts)
        cuts = np.cumsum([0, *map(len, texts)])
        starts = word_starts(data, cuts[:-1])
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)]
        ).dictionary_encode()
        ids = pa.array(self._remember(_values(words.dictionary)), pa.large_binary()).take(words.indices)
        _, places, raw = ids.buffers()
        ends = np.frombuffer(places, np.int64, len(starts) + 1)[np.searchsorted(starts, cuts)].tolist()
        return [raw[a:b].to_pybytes() for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=2)
def byte_bpe(path: str, plain: bool = False, remembered: int = 32 << 20) -> ByteBpe:
    """One per worker process and file; it remembers ``remembered`` bytes of words, twice as many at most."""
    return ByteBpe(path, remembered, plain)
