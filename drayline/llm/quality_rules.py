"""Quality rules combined by weak supervision.

Every rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over the vote patterns of all documents estimates how often each rule gives
each vote for good and for bad documents; the posterior probability of "good" under these estimates
decides, instead of demanding that all rules pass.

Counts are columns. Votes are column expressions. Documents are grouped by
vote pattern before anything leaves the executors: at most 3 ** (number of rules) patterns reach the
driver, whatever the corpus. The posterior is a sum of per-vote weights, again a column expression.

Defined cases: NULL and empty texts have no words, fail the base rule and take no part in the
estimate; an empty table gives an empty result (the prior estimates stay). Input columns with the
names of added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayline.llm.base import column_udf, staged, struct_array, texts_of

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_marks", "n_plain_words",
)
COUNTS_TYPE = "struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">"

SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Bytes a plain word is made of: letters, digits, bytes of other scripts, and at its end , . ; :
PLAIN = bytes(range(48, 58)) + UPPER + LOWER + bytes(range(128, 256)) + b"'-"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[bytes, int] = {}
    codes = np.fromiter(map(first.setdefault, words, counter()), np.int64, n)
    pairs = codes[:-1] * n + codes[1:]
    if n > 1 << 20:  # three codes no longer fit into 63 bits: number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n + codes[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= twice
    return int(covered.sum())


def counts_of(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    without = lambda some: len(raw) - len(raw.translate(None, some))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    plain = sum(1 for w in words if not w.rstrip(b",.;:").translate(None, PLAIN) and len(w) > 0)
    return (
        len(words),
        len(text) - sum(text.count(blank) for blank in BLANKS),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        without(UPPER),
        without(UPPER + LOWER),
        without(MARKS),
        plain,
    )


def _count_texts(texts: pa.Array) -> pa.Array:
    rows = [counts_of(text) for text in texts_of(texts)]
    columns = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
    return struct_array({n: pa.array(c, pa.int64()) for n, c in zip(COUNTS, columns, strict=True)})


def with_counts(df: DataFrame) -> DataFrame:
    """The input with the columns of COUNTS, taken from the whole text."""
    counts = column_udf(_count_texts, COUNTS_TYPE)
    kept = df.drop(*(set(COUNTS) & set(df.columns)))
    return kept.withColumn("_counts", counts(F.col("text"))).select(*kept.columns, "_counts.*")


@dataclass(frozen=True)
class Rule:
    """Votes by a ratio of two counts: bad beyond ``bad``, good within ``good``, else abstains."""

    name: str
    part: str
    whole: str
    good: float
    bad: float

    def vote(self) -> Column:
        ratio = F.col(self.part) / F.col(self.whole)
        if self.good < self.bad:
            good, bad = ratio <= self.good, ratio >= self.bad
        else:
            good, bad = ratio >= self.good, ratio <= self.bad
        return F.when(F.col(self.whole) <= 0, 0).when(bad, -1).when(good, 1).otherwise(0)


RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.02, 0.1),
    Rule("marks", "n_marks", "n_words", 0.1, 0.4),
    Rule("upper case", "n_upper", "n_letters", 0.15, 0.8),
    Rule("plain words", "n_plain_words", "n_words", 0.85, 0.6),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0.1, 0.4),
    Rule("repeated words", "n_repeat_words", "n_words", 0.1, 0.4),
    Rule("short words", "word_chars", "n_words", 3.0, 2.5),
    Rule("long words", "word_chars", "n_words", 11.0, 14.0),
)


@dataclass(frozen=True)
class RuleOptions:
    rules: tuple[Rule, ...] = RULES
    least_words: int = 50
    most_repeated: int = 50  # per cent of the words
    threshold: float = 0.5  # posterior probability of "good" that keeps a document
    rounds: int = 200
    #: Prior belief, as shares of the votes -1, 0, 1 for bad and for good documents: a bad vote is rarely
    #: wrong, a good vote says little. It counts as much as ``prior_share`` of the documents.
    prior_bad: tuple[float, float, float] = (0.35, 0.1, 0.55)
    prior_good: tuple[float, float, float] = (0.005, 0.045, 0.95)
    prior_share: float = 0.02
    good_share: float = 0.85  # of the documents, before looking


def base_failed(options: RuleOptions) -> Column:
    return (F.col("n_words") < options.least_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * options.most_repeated
    )


@dataclass(frozen=True)
class VoteModel:
    """share of good documents, and by rule and vote (-1, 0, 1) the probability for bad and good ones."""

    good_share: float
    bad: np.ndarray
    good: np.ndarray

    def posterior(self, votes: list[Column]) -> Column:
        weights = np.log(self.good) - np.log(self.bad)
        start = float(np.log(self.good_share) - np.log1p(-self.good_share))
        total = F.lit(start)
        for vote, (low, none, high) in zip(votes, weights.tolist(), strict=True):
            total = total + F.when(vote < 0, low).when(vote > 0, high).otherwise(none)
        return 1.0 / (1.0 + F.exp(-total))


def fit_votes(patterns: np.ndarray, documents: np.ndarray, options: RuleOptions) -> VoteModel:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and their document counts."""
    rules = len(options.rules)
    bad = np.tile(np.array(options.prior_bad), (rules, 1))
    good = np.tile(np.array(options.prior_good), (rules, 1))
    share, total = options.good_share, documents.sum()
    if not total:
        return VoteModel(share, bad, good)
    strength = options.prior_share * total + 1
    one_hot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    prior_bad, prior_good = bad * strength, good * strength
    before = None
    for _ in range(options.rounds):
        gap = np.log(share / (1 - share)) + (one_hot * (np.log(good) - np.log(bad))).sum((1, 2))
        p = 1 / (1 + np.exp(-np.clip(gap, -700, 700)))
        if before is not None and np.abs(p - before).max() < 1e-9:
            break
        before = p
        as_good, as_bad = documents * p, documents * (1 - p)
        good = prior_good + np.einsum("p,prv->rv", as_good, one_hot)
        bad = prior_bad + np.einsum("p,prv->rv", as_bad, one_hot)
        good /= good.sum(1, keepdims=True)
        bad /= bad.sum(1, keepdims=True)
        share = (as_good.sum() + strength * options.good_share) / (total + strength)
    return VoteModel(float(share), bad, good)


def fitted(counted: DataFrame, options: RuleOptions = RuleOptions()) -> VoteModel:
    """The vote model of all documents that pass the base rule. Input: the columns of COUNTS."""
    grouped = (
        counted.where(~base_failed(options))
        .groupBy(F.array(*(rule.vote().cast("int") for rule in options.rules)).alias("votes"))
        .agg(F.count("*").alias("n"))
        .collect()  # at most 3 ** rules rows
    )
    patterns = np.array([r["votes"] for r in grouped], dtype=int).reshape(-1, len(options.rules))
    order = np.lexsort(patterns.T)
    return fit_votes(patterns[order], np.array([r["n"] for r in grouped], dtype=float)[order], options)


def with_verdict(counted: DataFrame, model: VoteModel, options: RuleOptions = RuleOptions()) -> DataFrame:
    """Counted rows with base_failed, quality (posterior of "good") and kept."""
    return (
        counted.withColumn("base_failed", base_failed(options))
        .withColumn("quality", model.posterior([rule.vote() for rule in options.rules]))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= options.threshold))
    )


def judged(df: DataFrame, options: RuleOptions = RuleOptions()) -> DataFrame:
    """The input without its text, with its counts, base_failed, quality and kept; counted once and staged."""
    dropped = {"base_failed", "quality", "kept"} & set(df.columns)
    counted = staged(with_counts(df.drop(*dropped)).drop("text"), "rule-counts")
    return with_verdict(counted, fitted(counted, options), options)


def keep_good(df: DataFrame, options: RuleOptions = RuleOptions()) -> DataFrame:
    """The input's rows whose verdict is good, with the input's columns.

    Texts are counted twice, for the fit and for the verdict: that costs less than a written copy of the corpus.
    """
    model = fitted(with_counts(df.select("text")), options)
    clashing = set(df.columns) & {*COUNTS, "base_failed", "quality", "kept"}
    own = {c: f"_own_{c}" if c in clashing else c for c in df.columns}
    marked = with_verdict(with_counts(df.select(*(F.col(c).alias(name) for c, name in own.items()))), model, options)
    return marked.where("kept").select(*(F.col(name).alias(c) for c, name in own.items()))
