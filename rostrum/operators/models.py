"""Scaling, kernel features and classifiers on Spark ML.

A model function takes `(train, test, labels)`: tables with `key`, `y` and the
vector column `x` (standardised); it returns the test rows as
`(key, y, p, one score column per label)`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from rostrum.operators.forest import GROUP_ROWS, forest_votes
from rostrum.operators.machines import OneVsRest
from rostrum.operators.positions import hash_number
from rostrum.vocab import SEED, SVC_C

LANDMARKS = 256
TASK_CELLS = 1 << 22  # numbers, 32 MB, that a task of the machines' passes takes at least


def standardise(
    train: DataFrame, others: Sequence[DataFrame], vector: str = "x"
) -> tuple[list[DataFrame], int]:
    """Scale array column `vector` of all tables by the mean and population deviation
    of `train`; constant positions become 0. Also gives the number of positions
    that vary. Only two vectors come back to the driver."""
    model = StandardScaler(inputCol="_in", outputCol="_std", withMean=True, withStd=True).fit(
        train.select(array_to_vector(vector).alias("_in"))
    )
    # Spark divides by the sample deviation.
    n = train.count()
    factor = float(np.sqrt(n / (n - 1))) if n > 1 else 1.0
    stretch = ElementwiseProduct(
        inputCol="_std", outputCol="_out", scalingVec=Vectors.dense([factor] * len(model.std))
    )
    scaled = [
        stretch.transform(model.transform(df.withColumn("_in", array_to_vector(vector))))
        .withColumn(vector, F.col("_out")).drop("_in", "_std", "_out")
        for df in (train, *others)
    ]
    return scaled, int(np.count_nonzero(model.std.toArray()))


def scale_width(train: DataFrame, vector: str = "x") -> float:
    """1 / (positions * variance over all entries) of an array column, in one aggregate."""
    entries = train.select(F.size(vector).alias("d"), F.explode(vector).alias("v"))
    row = entries.agg(F.max("d").alias("d"), F.var_pop("v").alias("v")).first()
    return 1.0 / (row["d"] * row["v"]) if row["d"] and row["v"] else 1.0


def label_index(labels: Sequence[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("y")) - 1).cast("double")


def class_scores(df: DataFrame, labels: Sequence[str], prediction: str, probability: str) -> DataFrame:
    scores = vector_to_array(probability)
    return df.select(
        "key", "y",
        F.get(F.array(*[F.lit(c) for c in labels]), F.col(prediction).cast("int")).alias("p"),
        *[F.coalesce(F.get(scores, F.lit(k)), F.lit(0.0)).alias(c) for k, c in enumerate(labels)],
    )


def forest(
    train: DataFrame, test: DataFrame, labels: Sequence[str], trees: int = 100,
    depth: int = 30, seed: int = SEED, min_rows: int = 1, memory_mb: int = 256,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """A forest as Spark ML's, of binned splits over sqrt(positions) each, that neither the
    driver nor a task holds whole (see `operators/forest.py`)."""
    x = vector_to_array("x").alias("x")
    votes = forest_votes(
        train.select("key", label_index(labels).alias("y"), x), test.select("key", "y", x), len(labels),
        trees, depth, seed, min_rows, memory_mb, group_rows,
    )
    each = [F.coalesce(F.col(f"v{k}"), F.lit(0)) for k in range(len(labels))]
    total, most = sum(each[1:], each[0]), F.greatest(*each) if len(each) > 1 else each[0]
    return votes.select(
        "key", "y",
        F.get(F.array(*[F.lit(c) for c in labels]), F.array_position(F.array(*each), most).cast("int") - 1).alias("p"),
        *[F.coalesce(F.try_divide(v.cast("double"), total), F.lit(0.0)).alias(c) for v, c in zip(each, labels)],
    )


def kernel_features(
    train: DataFrame, gamma: float, landmarks: int = LANDMARKS, seed: int = SEED
) -> tuple[Callable[[np.ndarray], np.ndarray], int]:
    """A function from a matrix of vectors to their Nystroem features of the RBF kernel, and
    the number of features.

    The landmarks are the training rows of least key hash: at most `landmarks`
    vectors reach the driver, and go back to the tasks with the function.
    """
    rows = train.orderBy(hash_number("key", seed), "key").limit(landmarks).select("x").collect()
    points = np.array([r["x"].toArray() for r in rows])
    norms = (points ** 2).sum(axis=1)

    def kernel(x: np.ndarray) -> np.ndarray:
        square = (x ** 2).sum(axis=1)[:, None] + norms[None, :] - 2.0 * x @ points.T
        return np.exp(-gamma * np.maximum(square, 0.0))

    values, vectors = np.linalg.eigh(kernel(points))
    keep = values > values.max() * 1e-10
    root = vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T
    return lambda x: kernel(x) @ root, len(points)


def kernel_map(
    train: DataFrame, gamma: float, landmarks: int = LANDMARKS, seed: int = SEED
):
    """A Column function from vector `x` to its `kernel_features`."""
    mapped, _ = kernel_features(train, gamma, landmarks, seed)

    @F.pandas_udf("array<double>")
    def features(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(mapped(np.stack(x.to_numpy()))))

    return lambda x: array_to_vector(features(vector_to_array(x)))


def kernel_svc(
    train: DataFrame, test: DataFrame, labels: Sequence[str], width: float,
    c: float = SVC_C, landmarks: int = LANDMARKS, iterations: int = 50, seed: int = SEED,
) -> DataFrame:
    """Support vectors with an RBF kernel exp(-width |x - y|^2).

    Spark has no kernel machine: the kernel is mapped to explicit features, then
    one linear machine per class is fitted, and a logistic model turns their
    margins into probabilities. The machines pass over the features some fifty times
    (see `operators/machines.py`), so small tables are put into few tasks: one alone
    needs a single job.
    """
    mapped, size = kernel_features(train, width, landmarks, seed)
    n = train.count()
    rows = train.select(label_index(labels).alias("label"), vector_to_array("x").alias("x"))
    machines = OneVsRest(mapped, size, 1.0 / (c * n), iterations).fit(
        rows.coalesce(-(-n * landmarks // TASK_CELLS) or 1)
    )
    margins = rows.select("label", machines.margins("x").alias("margins")).persist()
    try:
        margins.count()  # before they are put into few tasks
        few = margins.coalesce(-(-n * len(labels) // TASK_CELLS) or 1)
        calibration = LogisticRegression(
            featuresCol="rawPrediction", labelCol="label", family="multinomial",
            rawPredictionCol="_raw", predictionCol="_best", maxIter=iterations,
        ).fit(few.select("label", array_to_vector("margins").alias("rawPrediction")))
    finally:
        margins.unpersist()
    told = test.withColumn("_margins", machines.margins(vector_to_array("x"))).withColumns({
        "rawPrediction": array_to_vector("_margins"),
        "chosen": F.array_position("_margins", F.array_max("_margins")) - 1,
    })
    return class_scores(calibration.transform(told), labels, "chosen", "probability")


def stratified_baseline(
    table: DataFrame, labels: Sequence[str], fold: str = "fold", seed: int = SEED
) -> DataFrame:
    """A random label per row, drawn from the class shares outside the row's fold.

    All folds in one query. The draw is the row's key hash, so it can be repeated.
    The shares are one row per fold, whatever the size of the table.
    """
    total = [F.sum(f"n{k}").alias(f"n{k}") for k in range(len(labels))]
    counts = table.groupBy(fold).agg(*[
        F.count(F.when(F.col("y") == c, 1)).alias(f"n{k}") for k, c in enumerate(labels)
    ])
    whole = counts.agg(F.struct(*total).alias("all")).scalar()
    rest = [F.col("_all")[f"n{k}"] - F.col(f"n{k}") for k in range(len(labels))]
    upto = [sum(rest[1:k + 1], rest[0]) for k in range(len(labels))]
    shares = counts.withColumn("_all", whole).select(
        F.col(fold).alias("_fold"),
        F.array(*[F.try_divide(u.cast("double"), upto[-1]) for u in upto]).alias("_upto"),
    )
    draw = hash_number("key", seed) / F.lit(float(1 << 32))
    place = F.size(F.filter("_upto", lambda u: u <= F.col("_draw")))
    drawn = table.withColumn("_draw", draw).join(
        F.broadcast(shares), F.col(fold) == F.col("_fold")
    ).withColumn("p", F.get(F.array(*[F.lit(c) for c in labels]), place))
    return drawn.select("key", "y", fold, "p", *[
        (F.col("p") == c).cast("double").alias(c) for c in labels
    ])


def principal_components(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """Add `pc1..pck` of the standardised vectors; in each component the loading of
    largest size is positive, which fixes the sign."""
    (scaled,), _ = standardise(df, [], vector)
    model = PCA(k=k, inputCol=vector, outputCol="_pc").fit(scaled.select(vector))
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    parts = vector_to_array("_pc")
    return model.transform(scaled).select(
        *[c for c in df.columns if c != vector],
        *[(F.get(parts, F.lit(i)) * float(signs[i])).alias(f"pc{i + 1}") for i in range(k)],
    )
