"""Text quality by a regularised quadratic discriminant over transformed document statistics.

Each class is a normal distribution over statistics of the whole text (lengths, shares of kinds of
characters, repetition), taken as logarithms or arc-hyperbolic sines and standardised. Its covariance is
shrunk towards the pooled covariance and towards a multiple of the identity; the Cholesky factor is
kept, so a Mahalanobis distance is one triangular product per text. The score is the logistic of the
difference of the two log densities plus the log prior, scaled by a fit on the training rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.toxicity import examples

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "bang": b"!?",
    "pipe": b"|",
    "symbol": b"#$%&*@^~<>{}[]\\/=+_`",
    "stop": b".,;:",
    "newline": b"\n",
    "blank": b" \t",
}
FEATURES = ("chars", "words", "word_length", "word_spread", "longest", *_KINDS, "wide", "distinct", "top_word", "top_pair", "distinct_lines", "line_length", "short_words", "marked_ends")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES; all defined for an empty text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    tokens = text.split()
    n = max(len(tokens), 1)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) if tokens else np.zeros(1, np.int64)
    counts = Counter(tokens)
    pairs = Counter(zip(tokens, tokens[1:]))
    lines = [x for x in text.split("\n") if x.strip()]

    def share(part: float) -> float:
        return math.log(part + 0.002)

    return [
        math.log1p(len(text)),
        math.log1p(len(tokens)),
        math.log1p(float(lengths.mean())),
        math.log1p(float(lengths.std())),
        math.log1p(int(lengths.max())),
        *(share(int(seen[list(kind)].sum()) / size) for kind in _KINDS.values()),
        share(int(seen[128:].sum()) / size),
        math.log((len(counts) + 1) / (n + 1)),
        share(max(counts.values(), default=0) / n),
        share(max(pairs.values(), default=0) / n),
        math.log((len(set(lines)) + 1) / (len(lines) + 1)),
        math.log1p(len(text) / max(len(lines), 1)),
        share(float((lengths <= 3).mean())),
        share(sum(not t[-1].isalnum() for t in tokens) / n),
    ]


@dataclass
class QualityModel:
    """Means and factors of both classes; a few kilobytes."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse Cholesky factors of the class covariances
    offsets: list[float]  # log prior less half the log determinant
    slope: float
    intercept: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density and prior of label 1 less those of label 0, for rows of statistics."""
        z = np.clip((x - self.shift) / self.scale, -12, 12)
        dens = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return dens[1] - dens[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        d = np.arcsinh(self.difference(x) / 4)
        return 1 / (1 + np.exp(-np.clip(self.slope * d + self.intercept, -35, 35)))

    def score(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(model.probability(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))))

        return of(text)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a one-dimensional logistic fit with a weak pull to (1, 0)."""
    w = np.array([1.0, 0.0])
    a = np.column_stack([x, np.ones_like(x)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (p - y) + 0.1 * (w - [1.0, 0.0])
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", *, max_examples: int = 20_000, pooled: float = 0.2, round_: float = 0.05, id_col: str = "doc_id", text: str = "text") -> QualityModel:
    """Fit on at most ``max_examples`` labelled documents outside the held-out part, taken in order of a hash of their id.

    ``pooled`` and ``round_`` are the shares of the pooled covariance and of the scaled identity. Without
    rows of both classes every text scores the smoothed rate of label 1.
    """
    known = examples(docs, labels, label, max_examples, id_col, text)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    rows = known.select("label", measured("text").alias("x")).collect()  # bounded by max_examples
    rows.sort(key=lambda r: (r["label"], r["x"]))
    d = len(FEATURES)
    x, y = np.array([r["x"] for r in rows], float).reshape(-1, d), np.array([r["label"] for r in rows], int)
    ones = int(y.sum())
    if not 0 < ones < len(y):
        rate = (ones + 1) / (len(y) + 2)
        return QualityModel(np.zeros(d), np.ones(d), [np.zeros(d)] * 2, [np.zeros((d, d))] * 2, [0.0, 0.0], 0.0, math.log(rate / (1 - rate)))
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - shift) / scale, -12, 12)
    groups = [z[y == c] for c in (0, 1)]
    means = [g.mean(axis=0) for g in groups]
    own = [(g - m).T @ (g - m) / len(g) for g, m in zip(groups, means)]
    both = sum(len(g) * s for g, s in zip(groups, own)) / len(y)
    factors, offsets = [], []
    for g, s in zip(groups, own):
        trust = len(g) / (len(g) + 2 * d)  # a class with few rows leans more on the pooled covariance
        mixed = trust * (1 - pooled) * s + (1 - trust * (1 - pooled)) * both
        mixed = (1 - round_) * mixed + round_ * np.trace(mixed) / d * np.eye(d)
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        offsets.append(math.log(len(g) / len(y)) - float(np.log(np.diag(lower)).sum()))
    model = QualityModel(shift, scale, means, factors, offsets, 1.0, 0.0)
    model.slope, model.intercept = logistic(np.arcsinh(model.difference(x) / 4), y.astype(float))
    return model


def scored(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "quality_score") -> DataFrame:
    """The documents with their score (0 to 1). Each row is scored by its own whole text, null as empty; rows are never joined."""
    return docs.withColumn(name, model.score(F.col(text).cast("string")))
