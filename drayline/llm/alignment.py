"""Alignment of two tokenizers' tokens, and how often ids are linked across the corpus.

A text's tokens by a byte-level BPE file (A, of a blank and the text) and by a SentencePiece model (B, which puts
the blank itself) are byte ranges of the same bytes. All ranges are sorted by start (lexsort); the running maximum of
their ends (maximum.accumulate) tells where a start reaches all that came before: there a group begins. Within groups
overlapping ranges are expanded to links.

Both tokenizers part a text before a run of blanks that follows a character other than a blank (no token of A holds
a blank behind another character, and no piece of B does; both are checked against the files). The text is cut
there, and equal stretches are encoded and aligned once a worker, new ones of a batch together; the memory for them
is bounded by bytes, in two generations.

The count of a pair of ids is the number of documents that hold it linked. Each document's distinct pairs are staged
with their number, counted by pair (summed up in the tasks before the shuffle), and meet their counts again in a
join: with a broadcast of the counts when they are measured to be few, else in a shuffle in which each pair is
spread over salted keys.

Defined cases: NULL and empty texts, and texts whose tokens don't spell them (B turns U+2581 into a blank), have no
tokens: zeros and an empty group text; special tokens' strings are plain text; very long texts are handled whole;
rows with the same id are documents of their own; an empty table gives an empty result. Columns of the input with
the names of the result are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayline.llm.base import column_udf, staged, struct_array, texts_of

BLANK = "▁"
#: A stretch begins with blanks and ends before blanks that follow no white space.
STRETCH = re.compile(r" +[^ ]*(?:(?<=\s) +[^ ]*)*")
#: What a remembered stretch takes beside its contents: dictionary slots, a tuple, heads of text and bytes.
ENTRY_BYTES = 500
LEARN_CHARS = 1 << 18
ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")


@dataclass(frozen=True)
class AlignOptions:
    tokenizer: str = ""  # path of a byte-level BPE file (A); empty: the public 50k one
    model: str = ""  # path of a SentencePiece model (B); empty: the public 32k one
    remembered: int = 32 << 20  # bytes of stretches a worker remembers; twice as many at most
    longest: int = 256  # characters of a remembered stretch
    broadcast_pairs: int = 1 << 21  # as many counted pairs are broadcast at most (about 40 bytes each)
    salts: int = 16  # keys that a pair is spread over in a shuffle


def paths(options: AlignOptions) -> tuple[str, str]:
    import public_tokenizers

    return (
        options.tokenizer or public_tokenizers.path("byte_bpe_50k.json"),
        options.model or public_tokenizers.path("piece_bpe_32k.model"),
    )


def byte_characters() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


# --- intervals ------------------------------------------------------------------------------------


def coalesced(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by start, group of each interval in that order): groups are unions of overlapping intervals."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = starts[order][1:] >= reach[:-1]
    return order, np.concatenate([np.zeros(min(1, len(order)), np.int64), np.cumsum(breaks)])


def overlaps(a_starts, a_ends, b_starts, b_ends) -> tuple[np.ndarray, np.ndarray]:
    """(index in A, index in B) of all overlapping pairs; both sides ascend and don't overlap themselves."""
    first = np.searchsorted(b_ends, a_starts, "right")
    count = np.searchsorted(b_starts, a_ends, "left") - first
    a = np.repeat(np.arange(len(a_starts)), count)
    within = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    return a, np.repeat(first, count) + within


#: What is known of a stretch: group text, pairs (A id << 32 | B id) as bytes, numbers of A tokens, B tokens, groups.
Aligned = tuple[bytes, bytes, int, int, int]


class Aligner:
    """Encodes and aligns stretches of text by one pair of vocabularies."""

    def __init__(self, tokenizer: str, model: str, remembered: int, longest: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer)
        self.library.encode_special_tokens = True
        with open(tokenizer, encoding="utf-8") as file:
            settings = json.load(file)
        split = settings["pre_tokenizer"] or {}
        if settings["normalizer"] is not None or split.get("type") != "ByteLevel" or not split.get("use_regex"):
            raise ValueError("A has to be a byte-level BPE file with the usual split")
        byte_of, size = byte_characters(), self.library.get_vocab_size()
        special = {t["id"] for t in settings["added_tokens"]}
        self.a_bytes = [b""] * size
        for piece, i in self.library.get_vocab().items():
            self.a_bytes[i] = piece.encode() if i in special else bytes(byte_of[c] for c in piece)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        if self.pieces.normalize("ﬁ  Á") != f"{BLANK}ﬁ{BLANK * 2}Á":
            raise ValueError("only models without text normalisation and with a leading blank are supported")
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any(BLANK in n.lstrip(BLANK) for n in names):
            raise ValueError("a piece of this model holds a blank after another character")
        self.b_bytes = [
            bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)
        ]
        self.a_sizes = np.array(list(map(len, self.a_bytes)))
        self.b_sizes = np.array(list(map(len, self.b_bytes)))
        self.lone_blank = self.pieces.piece_to_id(BLANK)
        self.spelled = [[f"{i}{mark}".encode() for i in range(max(size, len(names)))] for mark in ",|;"]
        self.remembered, self.longest = remembered, longest
        # two generations: what is met again moves to the young one, and the old one is dropped when that is full
        self.young: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}
        self.held = 0  # bytes of the young one

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A and by B of a text that begins with the blank B would put."""
        a = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.pieces.encode(text[1:], num_threads=1) if len(text) > 1 else [self.lone_blank]
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, stretches: list[str]) -> list[Aligned | None] | None:
        """Stretches that are parted when put together, aligned in one go; None if their tokens don't spell them."""
        text = "".join(stretches)
        raw = text.encode("utf-8", "surrogatepass")
        a, b = self.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
            return None
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        a_starts, b_starts = a_ends - self.a_sizes[a], b_ends - self.b_sizes[b]
        limits = np.cumsum([len(s.encode("utf-8", "surrogatepass")) for s in stretches])
        order, groups = coalesced(np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends]))
        group = np.empty(len(order), np.int64)
        group[order] = groups
        left, right = overlaps(a_starts, a_ends, b_starts, b_ends)
        pairs = (a[left] << 32 | b[right]).astype("<i8").tobytes()
        # group text: by group, A before B, in order; the mark behind an id tells what comes next
        ids, kind = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        written = np.lexsort((kind, group))  # stable: tokens of a kind stay in order
        ids, kind, group_w = ids[written], kind[written], group[written]
        mark = np.where(group_w[1:] != group_w[:-1], 2, kind[1:] - kind[:-1]).tolist() + [2]
        spelled = self.spelled
        pieces = [spelled[m][i] for m, i in zip(mark, ids.tolist(), strict=True)]
        # where each stretch ends: in A's tokens, in B's, in groups, in links
        a_cut, b_cut = np.searchsorted(a_ends, limits, "right"), np.searchsorted(b_ends, limits, "right")
        if len(stretches) > 1 and not (np.isin(limits, a_ends).all() and np.isin(limits, b_ends).all()):
            raise ValueError("the tokenizers don't part a text before blanks")
        g_cut = group[a_cut - 1] + 1
        l_cut = np.searchsorted(left, a_cut, "left")
        results: list[Aligned | None] = []
        a0 = b0 = g0 = l0 = 0
        for a1, b1, g1, l1 in zip(a_cut.tolist(), b_cut.tolist(), g_cut.tolist(), l_cut.tolist(), strict=True):
            told = b"".join(pieces[a0 + b0 : a1 + b1])[:-1]
            results.append((told, pairs[8 * l0 : 8 * l1], a1 - a0, b1 - b0, g1 - g0))
            a0, b0, g0, l0 = a1, b1, g1, l1
        return results

    def learn(self, stretches: list[str]) -> dict[str, Aligned | None]:
        """New stretches aligned. Those that end in no white space are put together: the tokenizers part them again."""
        known: dict[str, Aligned | None] = {}
        some: list[str] = []
        size = 0

        def finish() -> None:
            found = self.align(some) if some else []
            if found is None:  # some stretch isn't spelled by its tokens
                found = [(self.align([s]) or [None])[0] for s in some]
            known.update(zip(some, found, strict=True))
            some.clear()

        for stretch in stretches:
            if BLANK in stretch or stretch[-1].isspace():
                known[stretch] = (self.align([stretch]) or [None])[0]
                continue
            some.append(stretch)
            size += len(stretch)
            if size >= LEARN_CHARS:
                finish()
                size = 0
        finish()
        return known

    def of_texts(self, texts: list[str]) -> list[list[Aligned] | None]:
        """What is known of the stretches of each text; None without tokens."""
        parted = [STRETCH.findall(f" {t}") if t else [] for t in texts]
        wanted = set().union(*parted)
        found: dict[str, Aligned | None] = {}
        for memory in (self.young, self.old):
            found |= {s: memory[s] for s in wanted - found.keys() if s in memory}
        new = self.learn(sorted(wanted - found.keys()))
        found |= new
        if self.held >= self.remembered:
            self.old, self.young, self.held = self.young, {}, 0
        for s in wanted:
            if s not in self.young and len(s) <= self.longest:
                self.young[s] = one = found[s]
                self.held += ENTRY_BYTES + len(s) + (len(one[0]) + len(one[1]) if one else 0)
        results: list[list[Aligned] | None] = []
        for stretches in parted:
            one = [found[s] for s in stretches]
            results.append(None if not one or None in one else one)
        return results


@lru_cache(maxsize=2)
def aligner(tokenizer: str, model: str, remembered: int, longest: int) -> Aligner:
    """One per worker process and pair of vocabularies."""
    return Aligner(tokenizer, model, remembered, longest)


# --- columns --------------------------------------------------------------------------------------

ALIGNED = "struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups:string,pairs:array<bigint>,times:array<int>>"
GROUP_CHARS = 1 << 20


def aligned(text: Column, options: AlignOptions = AlignOptions(), digest: bool = False) -> Column:
    """Struct of a text's numbers of tokens, groups and links, its group text, and its distinct pairs of linked ids.

    groups: ``a1,a2|b1;a3|b2,b3``, with ``digest`` its SHA-256 in hex. pairs: A id << 32 | B id, ascending; times:
    the links of each.
    """
    tokenizer, model = paths(options)
    remembered, longest = options.remembered, options.longest

    def rows_of(tool: Aligner, texts: list[str]):
        for parts in tool.of_texts(texts):
            if parts is None:
                yield 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
                continue
            told, pairs, n_a, n_b, n_groups = zip(*parts, strict=True)
            links = np.frombuffer(b"".join(pairs), "<i8")
            groups = b";".join(told)
            shown = hashlib.sha256(groups).hexdigest() if digest else groups.decode()
            yield sum(n_a), sum(n_b), sum(n_groups), len(links), shown, *np.unique(links, return_counts=True)

    def run(column: pa.Array) -> pa.Array:
        tool, rows = aligner(tokenizer, model, remembered, longest), []
        some, size = [], 0
        for text in texts_of(column):  # some texts at a time, so that their new stretches are learned together
            some.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                rows += rows_of(tool, some)
                some, size = [], 0
        rows += rows_of(tool, some)
        n_a, n_b, n_groups, n_links, groups, pairs, times = zip(*rows, strict=True) if rows else ((),) * 7
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32))
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (pairs, times)]
        return struct_array(
            {
                "n_a": pa.array(n_a, pa.int64()), "n_b": pa.array(n_b, pa.int64()),
                "n_groups": pa.array(n_groups, pa.int64()), "n_links": pa.array(n_links, pa.int64()),
                "groups": pa.array(groups, pa.string()),
                "pairs": pa.ListArray.from_arrays(offsets, pa.array(flat[0], pa.int64())),
                "times": pa.ListArray.from_arrays(offsets, pa.array(flat[1].astype(np.int32))),
            }
        )

    return column_udf(run, ALIGNED)(text)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n_docs, best): of each pair of ids its documents, and whether no other pair of its A id has more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = staged(counts, "alignment-counts")
    a_id = F.shiftright("pair", 32).alias("a_id")
    most = counts.groupBy(a_id).agg(F.max("n_docs").alias("most"))  # an A id has as many pairs as B has ids, at most
    met = counts.withColumn("a_id", a_id).join(most, "a_id")
    return met.select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def with_alignment(df: DataFrame, options: AlignOptions = AlignOptions(), digest: bool = False) -> DataFrame:
    """The input's rows, without text, with n_a, n_b, n_groups, n_links, n_best, count_sum, groups, pairs and times.

    n_best: links whose pair is held by as many documents as any pair of their A id; count_sum: the documents of
    each link's pair, summed over links. With ``digest`` groups_sha256 stands for groups, pairs and times.
    """
    kept = [c for c in df.columns if c not in (*ADDED, "pairs", "times", "text")]
    found = df.select(*kept, aligned(F.col("text"), options, digest).alias("_found"))
    rows = found.select(*kept, "_found.*", F.monotonically_increasing_id().alias("_row"))
    rows = staged(rows, "alignment-documents")
    counts = staged(pair_counts(rows), "alignment-best")
    links = rows.select("_row", "times", F.posexplode("pairs").alias("_at", "pair"))
    links = links.select("_row", "pair", F.get("times", F.col("_at")).alias("times"))
    if counts.count() <= options.broadcast_pairs:
        met = links.join(F.broadcast(counts), "pair")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(options.salts - 1))).alias("salt")
        salted = links.withColumn("salt", F.pmod("_row", F.lit(options.salts)).cast("int"))
        met = salted.join(counts.select("*", salts), ["pair", "salt"])
    sums = met.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("n_docs")).cast("long").alias("count_sum"),
    )
    shown = [F.col("groups").alias("groups_sha256")] if digest else ["groups", "pairs", "times"]
    wanted = rows.drop("pairs", "times") if digest else rows
    return wanted.join(sums, "_row", "left").select(
        *kept, "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")),
        *shown,
    )
