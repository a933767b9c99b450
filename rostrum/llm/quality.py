"""Graded quality by ordinal regression on hashed text.

All grades share one weight vector over hashed byte 3-grams; ordered thresholds cut its
score: P(grade <= k) = 1 / (1 + exp(-(t_k - score))).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

SAMPLE_ROWS = 4096  # labelled rows the weights are fitted on
BITS = 12
GRAM = 3
PIECE = 1 << 20  # bytes hashed at once
PENALTY = 1e-4
STEPS = 400


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and square roots of the shares of hashed 3-grams of the whole text: a
    vector of length 1, and of length 0 for a text of under three bytes."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0)
    counts = np.zeros(1 << bits, np.int64)
    for at in range(0, n, PIECE):
        part = raw[at:at + PIECE + GRAM - 1].astype(np.uint32)
        code = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
        hashed = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        counts += np.bincount(hashed, minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at] / n)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one less than grades
    grades: np.ndarray  # ascending

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= g) for every grade but the least: one column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(score) @ np.diff(self.grades)


def fit_ordinal(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Ordinal:
    """Maximum likelihood with a squared penalty on the weights, by Adam on all rows.
    Thresholds are a first one and positive gaps, so they stay in order."""
    grades = np.unique(y)
    if len(grades) < 2:
        return Ordinal(np.zeros(x.shape[1]), np.empty(0), grades if len(grades) else np.zeros(1))
    at = np.searchsorted(grades, y)
    k = len(grades) - 1
    share = np.clip([(at <= i).mean() for i in range(k)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(x.shape[1]), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    d = x.shape[1]
    rows = np.arange(len(y))
    for step in range(1, steps + 1):
        gaps = np.exp(p[d + 1:])
        t = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = t[None, :] - (x @ p[:d].astype(x.dtype)).astype(float)[:, None]
        upto = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        cdf = np.column_stack([np.zeros(len(y)), upto, np.ones(len(y))])
        slope = np.column_stack([np.zeros(len(y)), upto * (1 - upto), np.zeros(len(y))])
        mass = np.maximum(cdf[rows, at + 1] - cdf[rows, at], 1e-12)
        # d(-log mass) with respect to the upper and the lower threshold of the row's grade
        above, below = -slope[rows, at + 1] / mass, slope[rows, at] / mass
        dt = np.zeros(k + 2)
        np.add.at(dt, at + 1, above)
        np.add.at(dt, at, below)
        dt = dt[1:-1] / len(y)
        grad = np.concatenate([
            -((above + below).astype(x.dtype) @ x).astype(float) / len(y) + penalty * p[:d],
            [dt.sum()], [dt[i + 1:].sum() * g for i, g in enumerate(gaps)],
        ])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        p = p - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    t = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1:]))])
    return Ordinal(p[:d], t, grades)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ordinal:
    """Fit on at most `rows` rated documents, taken by hash of their id. `docs`: id and
    text; `labels`: id and grade. An id rated twice takes the larger grade; without any
    rated document all texts get grade 0."""
    key, mark = labels.columns
    rated = labels.where(F.col(key).isNotNull() & F.col(mark).isNotNull()).groupBy(
        F.col(key).alias("id")
    ).agg(F.max(mark).cast("double").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    doc, text = docs.columns

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2),
                pa.array([c[0] for c in cells], pa.list_(pa.int16())),
                pa.array([c[1] for c in cells], pa.list_(pa.float32())),
            ], ["id", "y", "at", "value"])

    # `rows` sparse vectors of at most 2^BITS numbers; rows that repeat an id come once.
    got = docs.select(F.col(doc).alias("id"), F.col(text).alias("text")).join(
        F.broadcast(rated), "id"
    ).select(F.col("id").cast("bigint").alias("id"), "text", "y").mapInArrow(
        vectors, "id bigint, y double, at array<smallint>, value array<float>"
    ).groupBy("id").agg(F.min(F.struct("at", "value", "y")).alias("r")).orderBy("id").select("r.*").toArrow()
    x = np.zeros((got.num_rows, 1 << BITS), np.float32)
    for i in range(got.num_rows):
        x[i, got["at"][i].values.to_numpy()] = got["value"][i].values.to_numpy()
    return fit_ordinal(x, got["y"].to_numpy())


def quality_score(text: Column, model: Ordinal) -> Column:
    """The shared linear score; thresholds and grades turn it into the rest."""
    weights = model.weights

    @F.pandas_udf(DoubleType())
    def linear(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            at, value = features(t)
            out[i] = weights[at] @ value
        return pd.Series(out)

    return linear(text)


def grade_columns(score: Column, model: Ordinal) -> tuple[Column, Column]:
    """Expected grade, and the probability of the upper half of the grades, from `score`."""
    tail = [F.lit(1.0) / (1 + F.exp(F.lit(float(t)) - score)) for t in model.thresholds]
    expected = F.lit(float(model.grades[0]))
    for p, gap in zip(tail, np.diff(model.grades)):
        expected = expected + p * F.lit(float(gap))
    return expected, tail[len(tail) // 2] if tail else F.lit(1.0)
