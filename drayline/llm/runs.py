"""Runs: maximal stretches of a text whose words repeat with a period, found over its suffixes.

The suffixes of a text are sorted by prefix doubling, and the longest common prefixes (LCP) of neighbours follow
from the ranks of each doubling. Going down the LCPs, neighbours are united as Kruskal's algorithm unites nodes:
at LCP l the classes are the positions with l words in common. Each class keeps its positions in order; what is
put between two positions of the larger class makes newly adjacent pairs. A pair at distance d within its LCP
seeds a run of period d that goes on l words behind its second position. Two facts make this exact: a run's first
position and the one a period later have no other position of their class in between when their class comes up,
and adjacent positions within their LCP have the smallest period as their distance. So each run is found once, at
its first position, and pairs that can be extended to the left are left out.

Pairs count when all unions of an LCP are done, so ties don't matter. The texts of a batch are sorted together, up
to ``group_words`` words at a time: words get numbers that no two texts share, so no class spans texts. A text takes
about 8 bytes per word and doubling, and as many Python objects as it has words in repeated stretches.

Defined cases: NULL, empty and blank texts have no words and no runs; very long texts are worked on whole, one at a
time; repeated rows give repeated results. Columns of the input with the names of the result are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayline.llm.base import column_udf, struct_array, texts_of


@dataclass(frozen=True)
class RunOptions:
    least_words: int = 12  # of a run; it also holds its period twice
    group_words: int = 1 << 18  # words of texts that are sorted together


def doubled_ranks(ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For h = 1, 2, 4, ... the rank of every position by its next h words; in the last all ranks differ.

    ``ids``: number of each word, not shared between texts; ``ends``: for each position the end of its text. A rank
    is the number of positions that come before the class.
    """
    n = len(ids)
    sizes = np.bincount(ids)
    ranks = (np.cumsum(sizes) - sizes)[ids]
    open_ = np.flatnonzero(sizes[ids] > 1)  # positions whose rank isn't their own yet
    levels, step = [ranks.astype(np.int32)], 1
    while len(open_):
        after = open_ + step
        second = np.where(after < ends[open_], ranks[np.minimum(after, n - 1)], -1)
        key = ranks[open_] * np.int64(n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        key, places = key[order], open_[order]
        old = ranks[places]
        at = np.arange(len(key))
        new_class = np.concatenate([[True], old[1:] != old[:-1]])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        first_of_class = np.maximum.accumulate(np.where(new_class, at, 0))
        first_of_key = np.maximum.accumulate(np.where(new_key, at, 0))
        ranks = ranks.copy()
        ranks[places] = old + first_of_key - first_of_class
        alone = new_key & np.concatenate([new_key[1:], [True]])
        open_ = np.sort(places[~alone])
        levels.append(ranks.astype(np.int32))
        step *= 2
    return levels


def neighbours(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, next suffix's position, their LCP) of neighbouring suffixes with an LCP of ``least`` or more."""
    n = len(levels[0])
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    left, right = order[:-1], order[1:]
    # an LCP of 6 needs equal ranks for 4 words: most neighbours go here
    check = max(level for level in range(len(levels)) if 1 << level <= max(least, 1))
    close = levels[check][left] == levels[check][right]
    left, right = left[close], right[close]
    a, b = left.copy(), right.copy()
    padded = [np.append(level, -1) for level in levels]
    for level in range(len(levels) - 1, -1, -1):
        step = (padded[level][a] == padded[level][b]).astype(np.int64) << level
        a, b = a + step, b + step
    lcp = a - left
    kept = lcp >= least
    return left[kept], right[kept], lcp[kept]


def seeds(left: list[int], right: list[int], lcps: list[int]) -> Iterator[tuple[int, int, int]]:
    """(position, distance, LCP) of the pairs that become adjacent within their LCP; edges by falling LCP."""
    owner: dict[int, list[int]] = {}  # the ordered positions of a position's class
    after: dict[int, int] = {}  # the next position of its class
    fresh: list[tuple[int, int]] = []
    level = 0
    for a, b, lcp in zip(left, right, lcps, strict=True):
        if lcp != level:
            yield from ((i, j - i, level) for i, j in fresh if after[i] == j)
            fresh, level = [], lcp
        large, small = owner.get(a) or owner.setdefault(a, [a]), owner.get(b) or owner.setdefault(b, [b])
        if len(small) > len(large):
            large, small = small, large
        last = -1  # of the smaller class; two of its positions that stay adjacent are not newly so
        for x in small:
            k = bisect_left(large, x)
            if k:
                before = large[k - 1]
                after[before] = x
                if x - before <= lcp and before != last:
                    fresh.append((before, x))
            if k < len(large):
                behind = large[k]
                after[x] = behind
                if behind - x <= lcp:
                    fresh.append((x, behind))
            large.insert(k, x)
            owner[x] = large
            last = x
    yield from ((i, j - i, level) for i, j in fresh if after[i] == j)


def runs_of_words(ids: np.ndarray, ends: np.ndarray, options: RunOptions) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; positions count over all texts."""
    none = np.empty((0, 3), np.int64)
    if not len(ids):
        return none
    left, right, lcp = neighbours(doubled_ranks(ids, ends), max(1, -(-options.least_words // 2)))
    order = np.argsort(-lcp, kind="stable")
    found = np.array(list(seeds(left[order].tolist(), right[order].tolist(), lcp[order].tolist())), np.int64)
    if not len(found):
        return none
    start, period, common = found.T
    # the words before both positions differ, or the text starts here (numbers are not shared between texts)
    maximal = (start == 0) | (ids[start - 1] != ids[start + period - 1])
    long = common + period >= options.least_words
    found = np.stack([start, common + period, period], 1)[maximal & long]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def grouped(texts: list[str], most: int) -> Iterator[list[list[bytes]]]:
    """The words of texts, in groups of about ``most`` words."""
    group, size = [], 0
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()
        group.append(words)
        size += len(words)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def runs_of_texts(texts: list[str], options: RunOptions) -> Iterator[tuple[np.ndarray, str]]:
    """Per text: its runs (start, length, period) and the text without repetitions."""
    for group in grouped(texts, options.group_words):
        numbers: list[int] = []
        for words in group:
            base, known = len(numbers), {}
            # a word's number lies below the words counted so far, so no two texts share one
            numbers += [known.setdefault(w, base + len(known)) for w in words]
        sizes = np.array([len(words) for words in group], np.int64)
        bounds = np.cumsum(sizes)
        runs = runs_of_words(np.array(numbers, np.int64), np.repeat(bounds, sizes), options)
        cuts = np.searchsorted(runs[:, 0], bounds)
        first = 0
        for words, end, cut in zip(group, bounds.tolist(), cuts.tolist(), strict=True):
            own = runs[first:cut] - [end - len(words), 0, 0]
            first = cut
            if len(own):
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, own[:, 0] + own[:, 2], 1)
                np.add.at(edges, own[:, 0] + own[:, 1], -1)
                repeated = np.cumsum(edges[:-1]) > 0
                words = [w for w, drop in zip(words, repeated.tolist(), strict=True) if not drop]
            yield own, b" ".join(words).decode("utf-8", "surrogatepass")


FOUND = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def found_in(text: Column, options: RunOptions = RunOptions()) -> Column:
    """Struct of a text's runs, by start and period, and its words without what repeats, joined by one blank."""

    def run(texts: pa.Array) -> pa.Array:
        found = list(runs_of_texts(texts_of(texts), options))
        rows = np.concatenate([r for r, _ in found]) if found else np.empty((0, 3), np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r, _ in found])]).astype(np.int32)
        spans = struct_array({n: pa.array(rows[:, k]) for k, n in enumerate(("start", "length", "period"))})
        lists = pa.ListArray.from_arrays(pa.array(offsets), spans)
        return struct_array({"runs": lists, "collapsed": pa.array([c for _, c in found], pa.string())})

    return column_udf(run, FOUND)(text)


def with_runs(df: DataFrame, options: RunOptions = RunOptions()) -> DataFrame:
    """The input with runs and collapsed (the text without repetitions)."""
    kept = [c for c in df.columns if c not in ("runs", "collapsed")]
    found = df.select(*kept, found_in(F.col("text"), options).alias("_found"))
    return found.select(*kept, "_found.runs", "_found.collapsed")
