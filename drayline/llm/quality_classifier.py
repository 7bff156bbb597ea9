"""Naive Bayes support vectors: a linear quality classifier on scaled n-gram indicators.

A text is the set of its byte n-grams, hashed to ``2 ** bits`` features, and of its word n-grams that say
one word twice or thrice: those count as one n-gram whatever the word, at four shares of all words (any, a
fiftieth, a tenth, three tenths). Every indicator is multiplied
by the log-count ratio of its feature, log(share of it in good texts / share of it in bad texts), the
vector is brought to length 1, and dual coordinate descent fits a linear model with hinge loss. The
weights are mixed with their mean size, as a prior towards the naive Bayes direction. Margins become
probabilities by a sigmoid fitted on margins of documents that the model had not seen (folds by id).

The model is fitted on at most ``sample_rows`` labelled documents (a documented parameter), chosen by a
hash of their ids; one task gets their hashed features, the driver only the model. Scoring covers all rows:
one pass, no shuffle, the model (two arrays of ``2 ** bits`` numbers) goes to the tasks.

Defined cases: NULL and empty texts have no features and get the probability of an empty set of
n-grams; NULL ids have no label and are not held out; several labels of an id count as their
least; NULL labels are left out; repeated rows of an id count once in the fit; without labels every
score is 0.5; with labels of one class every score is that class's smoothed share. Input columns with
the names of added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayline.llm.base import column_udf, texts_of

FOLDS = 5
#: Shares of the words that are said at least twice (thrice) in a row; each has an n-gram of its own.
ECHO_SHARES = (0.0, 0.02, 0.1, 0.3)


@dataclass(frozen=True)
class ClassifierOptions:
    bits: int = 18  # the model has 2 ** bits features
    grams: tuple[int, ...] = (1, 2, 3, 4)  # bytes of an n-gram
    sample_rows: int = 4000  # labelled documents the model is fitted on, at most
    smoothing: float = 1.0  # added to every count
    cost: float = 1.0  # of the hinge loss
    passes: int = 20  # of dual coordinate descent
    prior_mix: float = 0.75  # how much of the fitted weights is kept against their mean size
    threshold: float = 0.3  # score from which a document is predicted good
    seed: int = 5


def features(text: str, options: ClassifierOptions) -> np.ndarray:
    """Sorted features of a text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.zeros(1 << options.bits, bool)
    for n, code in _gram_codes(raw, options.grams):
        seen[_bucket(code, n, options.bits)] = True
    words = raw.tobytes().split()
    twice = np.fromiter(map(eq, words, words[1:]), bool, max(len(words) - 1, 0))
    for n, same in ((2, twice), (3, twice[1:] & twice[:-1])):
        for step, share in enumerate(ECHO_SHARES):
            if same.any() and same.sum() >= share * len(words):
                seen[n * len(ECHO_SHARES) + step] = True
    return np.flatnonzero(seen).astype(np.int32)


def _gram_codes(raw: np.ndarray, grams: tuple[int, ...]):
    code = np.zeros(len(raw), np.uint32)
    for n in range(1, max(grams, default=0) + 1):
        if len(raw) < n:
            return
        # the n-gram that starts at each byte, as a number
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        if n in grams:
            yield n, code


def _bucket(code: np.ndarray, n: int, bits: int) -> np.ndarray:
    mixed = (code + np.uint32(0x632BE5AB * n & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)


@dataclass(frozen=True)
class Model:
    """margin = sum of weights / root of the sum of squared ratios + bias; score = sigmoid(slope * margin + offset)."""

    weights: np.ndarray  # fitted weight times ratio
    squares: np.ndarray  # squared ratio
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        size = float(self.squares[found].sum())
        return (float(self.weights[found].sum()) / size**0.5 if size else 0.0) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -60, 60))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, options: ClassifierOptions) -> np.ndarray:
    size = 1 << options.bits
    counts = np.full((2, size), options.smoothing)
    for found, label in zip(rows, good, strict=True):
        counts[int(label), found] += 1
    shares = counts / counts.sum(1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(
    rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, options: ClassifierOptions
) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over the scaled indicators, by dual coordinate descent.

    Minimises |w|^2 / 2 + cost * sum of max(0, 1 - y w x); the bias is the weight of a constant 1.
    """
    values = []
    for found in rows:
        scaled = ratios[found]
        values.append((scaled / max(float(np.sqrt(scaled @ scaled)), 1e-12)).astype(np.float32))
    diagonal = np.array([float(v @ v) + 1.0 for v in values])
    weights, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    cost = np.full(len(rows), options.cost)
    order = np.random.default_rng(options.seed)
    for _ in range(options.passes):
        largest = 0.0
        for i in order.permutation(len(rows)):
            found, x, y = rows[i], values[i], signs[i]
            gradient = y * (weights[found] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            step = (new - alpha[i]) * y
            if step:
                weights[found] += step * x
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return weights, bias


def fit_linear(rows: list[np.ndarray], good: np.ndarray, options: ClassifierOptions) -> Model:
    """Ratios, descent and the mix with the mean size; the sigmoid is still to be fitted."""
    ratios = log_count_ratios(rows, good, options)
    weights, bias = dual_descent(rows, np.where(good, 1.0, -1.0), ratios, options)
    used = weights != 0
    mean = np.abs(weights[used]).mean() if used.any() else 0.0
    mixed = options.prior_mix * weights + (1 - options.prior_mix) * mean * used
    return Model((mixed * ratios).astype(np.float32), (ratios**2).astype(np.float32), float(bias), 1.0, 0.0)


def fit_sigmoid(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of "good" by margin: Newton steps with smoothed targets."""
    n_good, n_bad = good.sum(), (~good).sum()
    targets = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    theta = np.zeros(2)

    def loss(t):
        z = x @ t
        return (np.logaddexp(0, z) - targets * z).sum() + 5e-4 * t[0] ** 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -60, 60)))
        slope = x.T @ (p - targets) + np.array([1e-3 * theta[0], 0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(theta - size * step) > loss(theta) and size > 1e-6:
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(theta[0]), 1e-6), float(theta[1])


def fit(rows: list[np.ndarray], good: np.ndarray, folds: np.ndarray, options: ClassifierOptions) -> Model:
    """The model of labelled feature sets; ``folds`` says which rows are left out together."""
    n = len(rows)
    if not n or good.all() or not good.any():
        share = (good.sum() + 1) / (n + 2)
        nothing = np.zeros(1 << options.bits, np.float32)
        return Model(nothing, nothing, 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.full(n, np.nan)
    for fold in np.unique(folds):
        out = folds == fold
        rest = good[~out]
        if not rest.any() or rest.all():
            continue
        part = fit_linear([r for r, o in zip(rows, out, strict=True) if not o], rest, options)
        margins[out] = [part.margin(r) for r, o in zip(rows, out, strict=True) if o]
    whole = fit_linear(rows, good, options)
    unseen = ~np.isnan(margins)
    if not unseen.any() or good[unseen].all() or not good[unseen].any():
        margins, unseen = np.array([whole.margin(r) for r in rows]), np.ones(n, bool)
    slope, offset = fit_sigmoid(margins[unseen], good[unseen])
    return Model(whole.weights, whole.squares, whole.bias, slope, offset)


# --- Spark ----------------------------------------------------------------------------------------


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def train(documents: DataFrame, labels: DataFrame, options: ClassifierOptions = ClassifierOptions()) -> Model:
    """The model of the labelled documents that are not held out."""
    fold = fold_of(F.col("doc_id"))
    known = (
        labels.where(F.col("quality").isNotNull() & (fold != 0))
        .groupBy("doc_id")
        .agg((F.min("quality") > 0).alias("good"))
        .join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(options.sample_rows)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features(t, options) for t in texts_of(texts)], pa.list_(pa.int32()))

    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids
        .select("doc_id", "good", fold.alias("fold"), column_udf(run, "array<int>")(F.col("text")).alias("found"))
        .groupBy("doc_id", "good", "fold")
        .agg(F.min("found").alias("found"))
    )

    def learn(batches):
        """The sample, in the order of ids, to one model."""
        sets, good, folds = [], [], []
        for batch in batches:
            found = batch.column("found")
            values, offsets = found.values.to_numpy(), found.offsets.to_numpy()
            sets += [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
            good += batch.column("good").to_pylist()
            folds += batch.column("fold").to_pylist()
        model = fit(sets, np.array(good, bool), np.array(folds, int), options)
        row = (model.weights.tobytes(), model.squares.tobytes(), model.bias, model.slope, model.offset)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["weights", "squares", "bias", "slope", "offset"])

    # one task for a bounded sample: an executor has the memory for it, the driver need not
    schema = "weights binary, squares binary, bias double, slope double, offset double"
    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, schema).first()
    if found is None:  # no labelled document
        return fit([], np.zeros(0, bool), np.zeros(0, int), options)
    weights, squares = (np.frombuffer(found[c], np.float32) for c in ("weights", "squares"))
    return Model(weights, squares, found["bias"], found["slope"], found["offset"])


def scored(documents: DataFrame, model: Model, options: ClassifierOptions = ClassifierOptions()) -> DataFrame:
    """The input with held_out, score and predicted."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(features(t, options)) for t in texts_of(texts)], pa.float64())

    return (
        documents.withColumn("held_out", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)))
        .withColumn("score", column_udf(run, "double")(F.col("text")))
        .withColumn("predicted", F.when(F.col("score") >= options.threshold, 1).otherwise(0))
    )


def keep_predicted(
    documents: DataFrame, model: Model, options: ClassifierOptions = ClassifierOptions()
) -> DataFrame:
    """The rows predicted good, with the input's columns."""
    own = [F.col(c).alias(f"_own_{i}") for i, c in enumerate(documents.columns)]
    marked = scored(documents.select("doc_id", "text", *own), model, options)
    return marked.where("predicted = 1").select(*(F.col(f"_own_{i}").alias(c) for i, c in enumerate(documents.columns)))
