"""N-best segmentation over the piece lattice of a SentencePiece model, and decoding.

A text's lattice has an edge for every piece of the vocabulary that spells a stretch of it; the score
of a segmentation is the sum of its pieces' scores. Viterbi scores from the front are exact heuristics
for A-star from the back: the agenda holds unfinished tails, each ranked by its own score plus the
Viterbi score of what is left, so segmentations come off it in order, best first. As the heuristic is
exact and tails stand for disjoint sets of segmentations, no more tails than results still wanted have
to be kept.

No piece holds a blank after another character (checked when the model is loaded), so every path passes
the border before a run of blanks. The lattice is cut there; equal stretches are solved once per worker
(the memory for them is bounded), and the N best of the text are merged from those of its stretches: only
the N - 1 stretches whose second-best costs least can differ from the best. The forward pass takes the new
stretches of many texts at once, as arrays.

A character without a piece of its own becomes byte pieces, at the model's lowest score less 10. Blanks
are written as the model writes them, with one put before a text that isn't empty; a text's own U+2581 becomes byte
pieces, so decoding gives back every text. Only models without text normalisation are accepted.

Defined cases: NULL and empty texts have one empty segmentation with score 0; texts with fewer than N
segmentations give all they have; ties keep the order in which the search meets them;
repeated rows give repeated results. Very long texts are segmented whole; a stretch without blanks is one lattice,
however long. Input columns with the names of added ones are replaced.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import nsmallest
from itertools import count
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayline.llm.base import column_udf, struct_array, texts_of

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")
#: What a remembered stretch takes beside its text and ids: two dictionary slots, a tuple, numbers and heads.
ENTRY_BYTES = 500
#: Stretches of up to so many characters go through the lattice together, so many characters of them at once.
SHORT_STRETCH = 32
PASS_CHARS = 1 << 16
#: Texts whose stretches are looked up together: as many as have this many characters, one at least.
GROUP_CHARS = 1 << 18


@dataclass(frozen=True)
class SegmentOptions:
    model: str = ""  # path of the model file; empty: the public 32k model
    paths: int = 4  # N
    remembered: int = 128 << 20  # bytes of solved stretches a worker remembers; twice as many at most


def model_path(options: SegmentOptions) -> str:
    if options.model:
        return options.model
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: A solved stretch: ids of its best segmentation as little-endian numbers, their score, and how much the second
#: best loses against it (infinite if there is none).
Solved = tuple[bytes, float, float]


class PieceTree:
    """The tree of pieces as arrays, for many stretches at once.

    Nodes are numbered, and so are the characters that are pieces themselves (others: 0). Children are found by
    bisection over parent and character.
    """

    def __init__(self, root: dict[str, list], longest: int):
        self.longest = longest
        alphabet = {char: k for k, char in enumerate((c for c, node in root.items() if node[2] is not None), 1)}
        self.width = len(alphabet) + 1
        self.number_of = np.zeros(0x110000, np.int32)
        self.number_of[[ord(c) for c in alphabet]] = list(alphabet.values())
        keys, scores, ids = [], [0.0], [-1]
        open_nodes = [(0, root)]
        while open_nodes:
            parent, children = open_nodes.pop()
            for char, (below, score, own) in children.items():
                if char in alphabet:
                    keys.append((parent * self.width + alphabet[char], len(scores)))
                    open_nodes.append((len(scores), below))
                    scores.append(score)
                    ids.append(-1 if own is None else int.from_bytes(own, "little"))
        keys.sort()
        self.keys = np.array([k for k, _ in keys], np.int64)
        self.children = np.array([c for _, c in keys], np.int64)
        self.scores, self.ids = np.array(scores), np.array(ids, np.int64)

    def step(self, nodes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child by their character, and those children."""
        wanted = nodes * self.width + numbers
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        there = self.keys[at] == wanted
        return there, self.children[at[there]]

    def edges(self, numbers: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and node of every piece in stretches that lie one behind the other, ending at ``stops``."""
        at, nodes = np.arange(len(numbers)), np.zeros(len(numbers), np.int64)
        found = []
        for size in range(1, self.longest + 1):
            there, nodes = self.step(nodes, numbers[at + (size - 1)])
            at = at[there]
            whole = self.ids[nodes] >= 0
            found.append((at[whole], np.full(np.count_nonzero(whole), size), nodes[whole]))
            inside = at + size < stops[at]
            at, nodes = at[inside], nodes[inside]
            if not len(at):
                break
        starts, sizes, ends = (np.concatenate(c) for c in zip(*found, strict=True))
        return starts, sizes, ends

    def two_best(self, texts: list[str]) -> list[Solved | None]:
        """``Segmenter.two_best`` of each stretch; None for those with a character that is no piece."""
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(t) for t in texts])
        numbers, first = self.number_of[flat].astype(np.int64), np.cumsum(lengths) - lengths
        known = np.minimum.reduceat(numbers, first) > 0
        if not known.all():
            some = iter(self.two_best([t for t, k in zip(texts, known, strict=True) if k]) if known.any() else ())
            return [next(some) if k else None for k in known]

        which = np.repeat(np.arange(len(texts)), lengths)
        starts, sizes, nodes = self.edges(numbers, (first + lengths)[which])
        # a stretch has one place more than characters
        place = starts + which[starts]
        front, back = first + np.arange(len(texts)), first + lengths + np.arange(len(texts))
        best, second = np.full(back[-1] + 1, NEVER), np.full(back[-1] + 1, NEVER)
        best[front] = 0.0
        last_size, last_node = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        # by end, and there by start: every stretch has one edge at most in each run of equal ranks
        rank = (place - front[which[starts]] + sizes) * (self.longest + 1) + self.longest - sizes
        order = np.argsort(rank, kind="stable")
        place, sizes, nodes, rank = place[order], sizes[order], nodes[order], rank[order]
        gains = self.scores[nodes]
        cuts = [0, *(np.flatnonzero(np.diff(rank)) + 1).tolist(), len(rank)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            size = sizes[low]
            through, end = best[place[low:high]] + gains[low:high], place[low:high] + size
            before = best[end]
            better = through > before
            second[end] = np.where(better, before, np.maximum(second[end], through))
            won = end[better]
            best[won] = through[better]
            last_size[won], last_node[won] = size, nodes[low:high][better]

        # the best paths, all stretches one piece back at a time
        at, losses, open_ones, steps = back.copy(), np.full(len(texts), -NEVER), np.arange(len(texts)), []
        while len(open_ones):
            here = at[open_ones]
            losses[open_ones] = np.minimum(losses[open_ones], best[here] - second[here])
            steps.append((open_ones, last_node[here]))
            at[open_ones] = here - last_size[here]
            open_ones = open_ones[at[open_ones] > front[open_ones]]
        owners, path = (np.concatenate(c) for c in zip(*reversed(steps), strict=True))
        ids = self.ids[path[np.argsort(owners, kind="stable")]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owners))).tolist()
        spelled = [ids[low:high] for low, high in zip([0, *ends], ends, strict=False)]
        return list(zip(spelled, best[back].tolist(), losses.tolist(), strict=True))


class Segmenter:
    """Lattice, N-best search and decoding of one model."""

    def __init__(self, path: str, remembered: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  Á") != f"{BLANK}ﬁ{BLANK * 2}Á":
            raise ValueError("only models without text normalisation and with a leading blank are supported")
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids = [0] * 256
        self.spelling: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelling.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelling.append(b"")
            else:
                self.pieces[piece] = (i, model.get_score(i))
                self.spelling.append(piece.replace(BLANK, " ").encode())
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece of this model holds a blank after another character")
        #: Pieces as a tree by character: what follows, and the score and ids of the piece that ends here, if any.
        self.longest = max(map(len, self.pieces))
        self.root: dict[str, list] = {}
        for piece, (i, score) in self.pieces.items():
            children = self.root
            for char in piece:
                node = children.setdefault(char, [{}, 0.0, None])
                children = node[0]
            node[1:] = score, i.to_bytes(4, "little")
        self.tree = PieceTree(self.root, self.longest)
        self.unknown = min(score for _, score in self.pieces.values()) - UNKNOWN_PENALTY
        alone = not any("\n" in p for p in self.pieces if len(p) > 1)  # then every path also stops at line ends
        self.stretches = re.compile(
            rf"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+" if alone else rf"{BLANK}+[^{BLANK}]*|[^{BLANK}]+"
        )
        self.remembered = remembered
        # two generations: what is met again moves to the young one, and the old one is dropped when that is full
        self.young: dict[str, Solved] = {}
        self.old: dict[str, Solved] = {}
        self.held = 0  # bytes of the young one

    def search(self, text: str, paths: int) -> list[tuple[float, bytes]]:
        """The best segmentations of a stretch, best first."""
        size, root, pieces, longest = len(text), self.root, self.pieces, self.longest
        best = [NEVER] * (size + 1)
        best[0] = 0.0
        # by end position: the best score through an edge, its start, its ids
        ends: list[list[tuple[float, int, bytes]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            before, children, j = best[i], root, i
            for char in text[i : i + longest]:
                node = children.get(char)
                if node is None:  # no piece starts like this
                    break
                j += 1
                children, score, ids = node
                if ids is not None:
                    through = before + score
                    ends[j].append((through, i, ids))
                    if through > best[j]:
                        best[j] = through
            if text[i] not in pieces:
                through = before + self.unknown
                ends[i + 1].append((through, i, self.bytes_of(text[i])))
                if through > best[i + 1]:
                    best[i + 1] = through
        # a tail's cost: what it has lost so far against the best path; what is left loses nothing
        agenda: list[tuple] = [(0.0, 0, size, None)]
        results: list[tuple[float, bytes]] = []
        order = 0
        while agenda:
            loss, _, position, tail = agenda.pop(0)
            wanted = paths - len(results) - 1
            while position:
                top, goes_on = best[position], None
                for edge in ends[position]:
                    more = top - edge[0]
                    if not more and goes_on is None:
                        goes_on = edge
                    elif wanted and (len(agenda) < wanted or loss + more < agenda[-1][0]):
                        order += 1
                        insort(agenda, (loss + more, order, edge[1], (edge[2], tail)))
                        del agenda[wanted:]
                _, position, ids = goes_on
                tail = (ids, tail)
            found = []
            while tail:
                found.append(tail[0])
                tail = tail[1]
            results.append((best[size] - loss, b"".join(found)))
            if len(results) == paths:
                break
        return results

    def two_best(self, text: str) -> Solved:
        """The best segmentation of a stretch and how much the second loses: what the search comes to for two paths.

        The second path leaves the best one, seen from the back, by the edge that loses least; it is enough to keep
        the two best scores through each position.
        """
        size, root, pieces, longest = len(text), self.root, self.pieces, self.longest
        best, second = [NEVER] * (size + 1), [NEVER] * (size + 1)
        best[0] = 0.0
        back: list = [None] * (size + 1)
        for i, first in enumerate(text):
            before, children, j = best[i], root, i
            for char in text[i : i + longest]:
                node = children.get(char)
                if node is None:
                    break
                j += 1
                children, score, ids = node
                if ids is not None:
                    through = before + score
                    if through > best[j]:
                        second[j], best[j], back[j] = best[j], through, (i, ids)
                    elif through > second[j]:
                        second[j] = through
            if first not in pieces:
                through, j = before + self.unknown, i + 1
                if through > best[j]:
                    second[j], best[j], back[j] = best[j], through, (i, self.bytes_of(first))
                elif through > second[j]:
                    second[j] = through
        found, loss, position = [], -NEVER, size
        while position:
            loss = min(loss, best[position] - second[position])
            position, ids = back[position]
            found.append(ids)
        found.reverse()
        return b"".join(found), best[size], loss

    def two_best_of(self, texts: list[str]) -> list[Solved]:
        """``two_best`` of distinct stretches: short ones together, as arrays, the others one by one."""
        solved: dict[str, Solved] = {}
        part: list[str] = []
        size = 0
        for text in [*(t for t in texts if len(t) <= SHORT_STRETCH), None]:
            if part and (text is None or size >= PASS_CHARS):
                solved.update((t, s) for t, s in zip(part, self.tree.two_best(part), strict=True) if s is not None)
                part, size = [], 0
            if text is not None:
                part.append(text)
                size += len(text)
        return [solved[t] if t in solved else self.two_best(t) for t in texts]

    def bytes_of(self, char: str) -> bytes:
        """The ids of a character spelled in bytes."""
        return b"".join(self.byte_ids[b].to_bytes(4, "little") for b in char.encode("utf-8", "surrogatepass"))

    def solve(self, stretches: list[str]) -> list[Solved]:
        """Best segmentation and second-best loss of each stretch; each distinct one is searched once."""
        found = list(map(self.young.get, stretches))
        open_ones = [k for k, known in enumerate(found) if known is None]
        if open_ones:
            solved = {stretches[k]: None for k in open_ones}
            solved = dict(zip(solved, map(self.old.get, solved), strict=True))
            new = [t for t, known in solved.items() if known is None]
            solved.update(zip(new, self.two_best_of(new), strict=True))
            for text, known in solved.items():
                if self.held >= self.remembered:
                    self.old, self.young, self.held = self.young, {}, 0
                self.young[text] = known
                self.held += ENTRY_BYTES + 4 * len(text) + len(known[0])
            for k in open_ones:
                found[k] = solved[stretches[k]]
        return found

    def stretches_of(self, text: str) -> tuple[list[str], list[int]]:
        """The stretches of a text, and which of them are a U+2581 of its own, spelled in bytes."""
        stretches: list[str] = []
        own: list[int] = []
        for k, part in enumerate(text.split(BLANK)):
            if k:
                own.append(len(stretches))
                stretches.append(BLANK)
            spelled = part.replace(" ", BLANK) if k else BLANK + part.replace(" ", BLANK)
            stretches += self.stretches.findall(spelled)
        return stretches, own

    def encode_all(self, texts: Iterable[str], paths: int) -> Iterator[list[tuple[float, bytes]]]:
        """``encode`` of each text; stretches of a group of texts are solved together."""
        group: list[tuple[list[str], list[int]]] = []
        size = 0
        for text in texts:
            group.append(self.stretches_of(text) if text else ([], []))
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._encoded(group, paths)
                group, size = [], 0
        yield from self._encoded(group, paths)

    def _encoded(self, group: list[tuple[list[str], list[int]]], paths: int) -> Iterator[list[tuple[float, bytes]]]:
        found = self.solve([s for stretches, _ in group for s in stretches])
        start = 0
        for stretches, own in group:
            mine = found[start : start + len(stretches)]
            start += len(stretches)
            for k in own:
                mine[k] = (self.bytes_of(BLANK), self.unknown, -NEVER)
            yield self._merged(stretches, mine, paths)

    def encode(self, text: str, paths: int) -> list[tuple[float, bytes]]:
        """The N best segmentations of a whole text: score and ids, best first."""
        return next(self.encode_all([text], paths))

    def _merged(self, stretches: list[str], found: list[Solved], paths: int) -> list[tuple[float, bytes]]:
        """The N best of a text from those of its stretches."""
        if not stretches:
            return [(0.0, b"")]
        ids, scores, losses = zip(*found, strict=True)
        total, best = float(sum(scores)), b"".join(ids)
        if paths == 1:
            return [(total, best)]
        # only the stretches with the smallest losses, the first ones among equals, can differ from the best
        combined: list[tuple[float, tuple]] = [(0.0, ())]
        for loss, where in sorted(nsmallest(paths - 1, zip(losses, count(), strict=False)), key=itemgetter(1)):
            if loss == -NEVER:
                continue
            (top, _), *others = self.search(stretches[where], paths)
            options = [(0.0, None)] + [(top - score, other) for score, other in others]
            both = [
                (lost + more, changes if other is None else (*changes, (where, other)))
                for lost, changes in combined
                for more, other in options
            ]
            both.sort(key=itemgetter(0))
            combined = both[:paths]
        results = [(total, best)]
        for lost, changes in combined[1:]:
            changed = list(ids)
            for where, other in changes:
                changed[where] = other
            results.append((total - lost, b"".join(changed)))
        return results

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelling.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        """The text that ids spell, without the blank put before it."""
        return self.decode_bytes(ids)[1:].decode("utf-8", "surrogatepass") if ids else ""


@lru_cache(maxsize=4)
def segmenter(path: str, remembered: int) -> Segmenter:
    """One per worker process and model."""
    return Segmenter(path, remembered)


SUMMARY = "struct<n_pieces:bigint,n_paths:int,scores:array<double>,ids_crc32s:array<bigint>,decodes:boolean>"


def segmentation_summary(text: Column, options: SegmentOptions = SegmentOptions()) -> Column:
    """Per text: pieces of the best path, the paths' scores and checksums, and whether the best decodes to the text."""
    path, paths, remembered = model_path(options), options.paths, options.remembered

    def run(texts: pa.Array) -> pa.Array:
        tool, rows = segmenter(path, remembered), []
        every = texts_of(texts)
        for one, found in zip(every, tool.encode_all(every, paths), strict=True):
            rows.append(
                (
                    len(found[0][1]) // 4,
                    len(found),
                    [s for s, _ in found],
                    [zlib.crc32(ids) for _, ids in found],
                    tool.decode(found[0][1]) == one,
                )
            )
        kinds = {
            "n_pieces": pa.int64(), "n_paths": pa.int32(), "scores": pa.list_(pa.float64()),
            "ids_crc32s": pa.list_(pa.int64()), "decodes": pa.bool_(),
        }
        return struct_array({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds.items())})

    return column_udf(run, SUMMARY)(text)


def best_ids(text: Column, options: SegmentOptions = SegmentOptions()) -> Column:
    """Struct (piece_ids, score, margin): the best segmentation and how far the second is behind (NULL: none)."""
    path, paths, remembered = model_path(options), options.paths, options.remembered

    def run(texts: pa.Array) -> pa.Array:
        tool = segmenter(path, remembered)
        found = list(tool.encode_all(texts_of(texts), paths))
        lengths = np.array([len(f[0][1]) // 4 for f in found], np.int64)
        ids = np.frombuffer(b"".join(f[0][1] for f in found), "<u4").astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return struct_array(
            {
                "piece_ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                "score": pa.array([f[0][0] for f in found], pa.float64()),
                "margin": pa.array([f[0][0] - f[1][0] if len(f) > 1 else None for f in found], pa.float64()),
            }
        )

    return column_udf(run, "struct<piece_ids:array<int>,score:double,margin:double>")(text)


def decoded(ids: Column, options: SegmentOptions = SegmentOptions()) -> Column:
    """The text that an array of piece ids spells."""
    path, remembered = model_path(options), options.remembered

    def run(rows: pa.Array) -> pa.Array:
        tool = segmenter(path, remembered)
        return pa.array(
            [None if r is None else tool.decode(np.array(r, "<u4").tobytes()) for r in rows.to_pylist()], pa.string()
        )

    return column_udf(run, "string")(ids)


def with_segments(df: DataFrame, options: SegmentOptions = SegmentOptions()) -> DataFrame:
    """The input with piece_ids, n_pieces, score and margin."""
    kept = df.drop(*({"piece_ids", "n_pieces", "score", "margin"} & set(df.columns)))
    found = kept.withColumn("_best", best_ids(F.col("text"), options))
    return found.select(
        *kept.columns, "_best.piece_ids", F.size("_best.piece_ids").cast("long").alias("n_pieces"), "_best.score", "_best.margin"
    )
