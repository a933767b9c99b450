"""Kernel ridge machines over many landmarks.

Landmarks are drawn by approximate ridge leverage scores: a row that the rows drawn so far
explain badly is drawn more often. The system over the landmarks is solved by conjugate
gradients, preconditioned by the landmarks' own kernel. A step is one job: each task sums
its kernel blocks to a row per landmark, and nothing of the size of the table is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from rostrum.operators.models import class_scores, label_index
from rostrum.operators.positions import hash_number
from rostrum.vocab import SEED, SVC_C

LANDMARKS = 1024
PILOT = 256  # rows the leverage scores are estimated with
BLOCK = 1024  # rows of a kernel block
STEPS = 60
GAP = 1e-6  # of the residual, where the steps end


def rbf(x: np.ndarray, points: np.ndarray, gamma: float) -> np.ndarray:
    square = (x ** 2).sum(axis=1)[:, None] + (points ** 2).sum(axis=1)[None, :] - 2.0 * x @ points.T
    return np.exp(-gamma * np.maximum(square, 0.0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`(x, label)` of at most BLOCK rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            part = whole.slice(at, BLOCK)
            yield part.column(0).flatten().to_numpy().reshape(part.num_rows, -1), part.column(1).to_numpy()


def _per_landmark(
    rows: DataFrame, shape: tuple[int, int], add: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> np.ndarray:
    """The sum of `add(x, label)`, a matrix of `shape`, over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x, label in _blocks(batches):
            total += add(x, label)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(shape[0], dtype=np.int32)), *map(pa.array, total.T)], ["at", *names])

    names = [f"s{c}" for c in range(shape[1])]
    sums = rows.select("x", "label").mapInArrow(
        run, ", ".join(["at int", *[f"{n} double" for n in names]])
    ).groupBy("at").agg(*[F.sum(n).alias(n) for n in names])
    out = np.zeros(shape)
    for r in sums.collect():  # a row per landmark
        out[r["at"]] = [r[n] for n in names]
    return out


def leverage_landmarks(
    rows: DataFrame, gamma: float, ridge: float, landmarks: int = LANDMARKS, pilot: int = PILOT,
    seed: int = SEED,
) -> tuple[np.ndarray, np.ndarray]:
    """At most `landmarks` different vectors and the rows each stands for.

    `rows`: key and array x; `ridge`: the penalty times the number of rows. The pilot is the
    rows of least key hash. A row's score is what the pilot leaves of its kernel; rows are
    drawn without putting back, in proportion to it, by another hash of the key, so the draw
    repeats under any partitioning. With no more rows than `landmarks` all are drawn.
    """
    drawn = rows.orderBy(hash_number("key", seed), "key").limit(pilot).select("x").collect()
    points = np.array([r["x"] for r in drawn])
    n = rows.count()
    inverse = np.linalg.inv(rbf(points, points, gamma) + ridge * len(points) / n * np.eye(len(points)))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        out = [np.empty(0)]
        for at in range(0, len(x), BLOCK):
            k = rbf(np.stack(x.iloc[at:at + BLOCK].to_numpy()), points, gamma)
            out.append(1.0 - ((k @ inverse) * k).sum(axis=1))
        # At most 1, and never 0: every row may be drawn.
        return pd.Series(np.clip(np.concatenate(out) / ridge, 1e-6, 1.0))

    uniform = (hash_number("key", seed + 1) + 1) / F.lit(float((1 << 32) + 1))
    scored = rows.select("key", "x", score("x").alias("score")).persist()
    try:
        total = scored.agg(F.sum("score")).first()[0]
        taken = scored.orderBy(-F.log(uniform) / F.col("score"), "key").limit(landmarks).select("x", "score").collect()
    finally:
        scored.unpersist()
    stands = np.maximum(1.0, total / (np.array([r["score"] for r in taken]) * len(taken)))
    if len(taken) == n:
        stands[:] = 1.0
    points, which = np.unique(np.array([r["x"] for r in taken]), axis=0, return_inverse=True)
    return points, np.bincount(which.ravel(), stands)


def solve(
    rows: DataFrame, classes: int, points: np.ndarray, stands: np.ndarray, gamma: float,
    ridge: float, steps: int = STEPS, gap: float = GAP,
) -> tuple[np.ndarray, int]:
    """Weights of the landmarks, a column per class, and the steps taken. `rows`: array x and
    label; a class's targets are 1 for its rows and -1 for others.

    Minimises the squared error plus `ridge` times the squared norm. The driver holds
    three matrices of landmarks by landmarks.
    """
    m = len(points)
    own = rbf(points, points, gamma)
    own[np.diag_indices(m)] += 1e-10 * m
    upper = np.linalg.cholesky(own).T
    inner = np.linalg.cholesky((upper * stands) @ upper.T + ridge * np.eye(m)).T
    to_weights = np.linalg.inv(inner @ upper)

    def targets(x: np.ndarray, label: np.ndarray) -> np.ndarray:
        y = np.where(label[:, None] == np.arange(classes)[None, :], 1.0, -1.0)
        return rbf(x, points, gamma).T @ y

    def system(v: np.ndarray) -> np.ndarray:
        weights = to_weights @ v

        def add(x: np.ndarray, _: np.ndarray) -> np.ndarray:
            k = rbf(x, points, gamma)
            return k.T @ (k @ weights)

        return to_weights.T @ (_per_landmark(rows, weights.shape, add) + ridge * (own @ weights))

    rest = to_weights.T @ _per_landmark(rows, (m, classes), targets)
    found, way = np.zeros_like(rest), rest.copy()
    size = (rest ** 2).sum(axis=0)
    goal, taken = size * gap ** 2, 0
    while taken < steps and (size > goal).any():
        image = system(way)
        open_ = size > goal  # a class that is solved stays as it is
        pace = np.where(open_, size / np.where(open_, (way * image).sum(axis=0), 1.0), 0.0)
        found += pace * way
        rest -= pace * image
        left = (rest ** 2).sum(axis=0)
        way = np.where(open_, rest + left / np.where(open_, size, 1.0) * way, way)
        size = np.where(open_, left, size)
        taken += 1
    return to_weights @ found, taken


def margins(points: np.ndarray, weights: np.ndarray, gamma: float):
    """A Column function from array `x` to one margin per class."""
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for at in range(0, len(x), BLOCK):
            out.extend(rbf(np.stack(x.iloc[at:at + BLOCK].to_numpy()), points, gamma) @ weights)
        return pd.Series(out, dtype=object)

    return run


def kernel_ridge(
    train: DataFrame, test: DataFrame, labels: Sequence[str], width: float, c: float = SVC_C,
    landmarks: int = LANDMARKS, pilot: int = PILOT, steps: int = STEPS, gap: float = GAP, seed: int = SEED,
) -> DataFrame:
    """A kernel machine exp(-width |x - y|^2) with squared loss, one target per class.

    For tables where a few hundred landmarks are too coarse. A logistic model turns margins
    into probabilities, and the most probable class is the prediction: the largest margin
    would favour the largest class. Training rows without a label or a vector take no part.
    """
    rows = train.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        "key", vector_to_array("x").alias("x"), label_index(labels).alias("label")
    ).persist()
    try:
        points, stands = leverage_landmarks(rows, width, 1.0 / c, landmarks, pilot, seed)
        weights, _ = solve(rows, len(labels), points, stands, width, 1.0 / c, steps, gap)
        margin = margins(points, weights, width)
        calibration = LogisticRegression(
            featuresCol="_margin", labelCol="label", family="multinomial", rawPredictionCol="_raw",
            predictionCol="_best", probabilityCol="probability",
        ).fit(rows.select("label", array_to_vector(margin("x")).alias("_margin")))
    finally:
        rows.unpersist()
    scored = test.withColumn("_margin", array_to_vector(margin(vector_to_array("x"))))
    return class_scores(calibration.transform(scored), labels, "_best", "probability")
