"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (words, word pairs, word shapes, their pairs, and pairs of immediate repeats) are scaled by the log-count ratio of the two
classes; a linear model with hinge loss is fitted to the scaled indicators by dual coordinate descent, and a sigmoid
fitted on held-out folds turns its margin into a probability. Every model has the same size: indicators are hashed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketprose.llm.common import Recent, forget_recent, mixed, word_hashes

BITS = 20  # of a hashed indicator
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Signs(Recent):
    """Code point to the sign of its class: B a capital, a another letter or mark, 0 a digit; others stand for themselves."""

    _classes = ((regex.compile(r"[\p{Lu}\p{Lt}]"), "B"), (regex.compile(r"[\p{L}\p{M}]"), "a"), (regex.compile(r"\p{N}"), "0"))

    def compute(self, point: int) -> str:
        sign = chr(point)
        return next((s for pattern, s in self._classes if pattern.match(sign)), sign)


class Shapes(Recent):
    """Hash of a word's shape, from its signs: runs of capitals, other letters and digits as one sign each, others as two."""

    _runs = ((re.compile(r"([aB0])\1+"), r"\1"), (re.compile(r"([^aB0])\1+"), r"\1\1"))

    def compute(self, signs: str) -> int:
        for pattern, short in self._runs:
            signs = pattern.sub(short, signs)
        return hash_text(signs)


def hash_text(text: str) -> int:
    hashes = word_hashes(text.replace(" ", "_"))
    return int(hashes[0]) if len(hashes) else 0


_SIGNS, _SHAPES = Signs(8 << 20), Shapes()


def indicators(text: str) -> np.ndarray:
    """Sorted distinct hashed n-grams of a whole text. An empty text has those of its two ends."""
    hashes = word_hashes(text)
    # signs of a whole text at once: far fewer of them than words differ
    shapes = np.fromiter(map(_SHAPES.__getitem__, text.translate(_SIGNS).split()), np.uint64)
    ends = np.array([1], np.uint64), np.array([2], np.uint64)
    hashes, shapes = (np.concatenate([ends[0], x, ends[1]]) for x in (hashes, shapes))
    with np.errstate(over="ignore"):
        grams = [
            mixed(hashes ^ _SEEDS[0]),
            mixed(hashes[:-1] * _SEEDS[1] + hashes[1:]),
            mixed(shapes ^ _SEEDS[2]),
            mixed((shapes[:-1] * _SEEDS[3] + shapes[1:]) ^ _SEEDS[2]),
        ]
        same = (hashes[1:] == hashes[:-1]).astype(np.uint64)  # does a word repeat the one before?
        grams.append(mixed((same[:-1] * np.uint64(2) + same[1:] + np.uint64(3)) * _SEEDS[1]))
    return np.unique((np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int32))


@dataclass
class Model:
    """Log-count ratios, weights of the scaled indicators, bias and the sigmoid of the margin."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        return margin(self.ratio, self.weight, self.bias, found)

    def score(self, text: str) -> float:
        z = self.slope * self.margin(indicators(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def margin(ratio: np.ndarray, weight: np.ndarray, bias: float, found: np.ndarray) -> float:
    scaled = ratio[found]
    norm = float(np.sqrt(scaled @ scaled))
    return float(weight[found] @ scaled) / norm + bias if norm else bias


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of (share of an indicator among the good) / (share among the bad); 0 for indicators never seen."""
    counts = []
    for wanted in (True, False):
        mine = [r for r, g in zip(rows, good, strict=True) if g == wanted]
        counts.append(np.bincount(np.concatenate([np.zeros(0, np.int32), *mine]), minlength=1 << BITS))
    p, q = counts[0] + smoothing, counts[1] + smoothing
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(counts[0] + counts[1]) == 0] = 0
    return ratio.astype(np.float32)


def dual_descent(
    rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 30, tol: float = 1e-2, seed: int = 0
) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model, by dual coordinate descent over rows scaled to unit length.

    The rarer class costs as much in total as the other. Ends when the projected gradients of an epoch lie within
    ``tol`` of each other, or after ``epochs``.
    """
    weight, bias = np.zeros(1 << BITS, np.float64), 0.0
    values = []
    for row in rows:
        scaled = ratio[row].astype(np.float64)
        values.append(scaled / (np.sqrt(scaled @ scaled) or 1.0))
    sign = np.where(good, 1.0, -1.0)
    shares = {True: len(good) / max(1, 2 * good.sum()), False: len(good) / max(1, 2 * (~good).sum())}
    limit = np.array([cost * shares[bool(g)] for g in good])
    square = np.array([v @ v + 1.0 for v in values])  # the bias is an indicator that all rows have
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        highest, lowest = -np.inf, np.inf
        for i in rng.permutation(len(rows)):
            row, x = rows[i], values[i]
            gradient = sign[i] * (weight[row] @ x + bias) - 1.0
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == limit[i] else gradient
            highest, lowest = max(highest, projected), min(lowest, projected)
            if projected:
                new = min(max(alpha[i] - gradient / square[i], 0.0), limit[i])
                step = (new - alpha[i]) * sign[i]
                alpha[i] = new
                weight[row] += step * x
                bias += step
        if highest - lowest < tol:
            break
    return weight.astype(np.float32), bias


def sigmoid(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of ``good`` by Newton steps; targets drawn in by the class counts."""
    n_good, n_bad = int(good.sum()), int((~good).sum())
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    beta = np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (p - target)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(slope).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], good: np.ndarray, folds: int = 4) -> Model:
    """The model of labelled rows; without two classes a constant one that knows their share only."""
    good = np.asarray(good, bool)
    if good.all() or not good.any():
        share = (good.sum() + 1) / (len(good) + 2)
        empty = np.zeros(1 << BITS, np.float32)
        return Model(empty, empty, 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(rows))
    for k in range(folds):
        test = np.arange(len(rows)) % folds == k
        train = ~test
        if good[train].all() or not good[train].any():
            continue
        part = [rows[i] for i in np.flatnonzero(train)]
        ratio = log_count_ratio(part, good[train])
        weight, bias = dual_descent(part, good[train], ratio)
        margins[test] = [margin(ratio, weight, bias, rows[i]) for i in np.flatnonzero(test)]
    slope, offset = sigmoid(margins, good)
    ratio = log_count_ratio(rows, good)
    weight, bias = dual_descent(rows, good, ratio)
    return Model(ratio, weight, bias, slope, offset)


def fit_labelled(
    docs: DataFrame,
    labels: DataFrame,
    use: Column | None = None,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    max_rows: int = 6000,
) -> Model:
    """Fit on labelled documents.

    The sample is the ``max_rows`` label rows with the smallest key hash; that bounds what the fit holds, in the driver
    too. Labels that are null, or whose key is null or has no document, are not used; ``use`` is a condition on
    the key column. A key with several labels counts once for each.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    if use is not None:
        chosen = chosen.filter(use)
    chosen = chosen.select(F.col(key).alias("_key"), (F.col(label) > 0).alias("good"))
    sample = chosen.orderBy(F.xxhash64("_key"), "_key", "good").limit(max_rows)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(sample), "_key")  # at most max_rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_recent()
        for batch in batches:
            found = [indicators(t).tobytes() for t in batch["_text"]]
            yield pd.DataFrame({"key": batch["_key"], "good": batch["good"], "found": found})
        forget_recent()

    got = rows.mapInPandas(run, "key bigint, good boolean, found binary").collect()
    got.sort(key=lambda r: (r["key"], r["good"], bytes(r["found"])))
    return fit([np.frombuffer(r["found"], np.int32) for r in got], np.array([r["good"] for r in got], bool))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that the whole text is good; null texts count as empty.

    Rows are independent of each other. A column that has the name already is replaced. The model has a fixed size
    (2^20 pairs of 4-byte numbers), so it is broadcast.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_recent()
        for texts in batches:
            yield texts.map(shared.value.score).astype(float)
        forget_recent()

    return docs.withColumn(name, probability(F.coalesce(F.col(text), F.lit(""))))
