"""Weighted mean and deviation of vectors, position by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from rostrum.functions.numeric import finite


def weighted_vector_stats(
    df: DataFrame, keys: Sequence[str], vector: str, weight: str
) -> DataFrame:
    """Per group: `vec_mean`, population `vec_std`, and `vectors` (their number).

    Spark ML's Summarizer folds whole vectors before the shuffle, so nothing is
    exploded and a large group is one buffer per task. It divides by an unbiased
    weight sum and refuses negative weights; both are undone here: its variance is
    turned back into a sum of squares, and positive and negative weights are
    summed apart and subtracted. Groups with total weight zero, a missing weight or
    vectors of different lengths get NULL. Empty vectors do not count.
    """
    keys = list(keys)
    w = F.col("w")
    parts = (
        df.where(F.size(vector) > 0)
        .select(
            *keys,
            F.transform(
                F.col(vector).cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan")))
            ).alias("v"),
            F.col(weight).cast("double").alias("w"),
        )
        .groupBy(*keys, F.signum("w").alias("sign"), F.size("v").alias("width"))
        .agg(
            Summarizer.metrics("mean", "variance").summary(
                array_to_vector("v"), F.when(w != 0, F.abs(w)).otherwise(1.0)
            ).alias("s"),
            F.sum(F.abs("w")).alias("total"),
            F.sum(w * w).alias("squares"),
            F.count("*").alias("n"),
        )
        .select(*keys, "sign", "width", "n", F.struct(
            F.col("total"),
            vector_to_array("s.mean").alias("mean"),
            F.transform(
                vector_to_array("s.variance"),
                lambda x: x * (F.col("total") - F.try_divide(F.col("squares"), F.col("total"))),
            ).alias("dev"),
        ).alias("part"))
    )
    sides = parts.groupBy(*keys).agg(
        F.max(F.when(F.col("sign") > 0, F.col("part"))).alias("p"),
        F.max(F.when(F.col("sign") < 0, F.col("part"))).alias("q"),
        ((F.min("width") == F.max("width")) & ~F.max(F.col("sign").isNull())).alias("even"),
        F.sum("n").alias("vectors"),
    )
    total = F.coalesce("p.total", F.lit(0.0)) - F.coalesce("q.total", F.lit(0.0))
    zero = F.transform(F.coalesce("p.mean", "q.mean"), lambda x: F.lit(0.0))
    none = F.struct(F.lit(0.0).alias("total"), zero.alias("mean"), zero.alias("dev"))
    sides = sides.select(
        *keys, "vectors", "even", total.alias("total"),
        F.coalesce("p", none).alias("p"), F.coalesce("q", none).alias("q"),
    )
    p, q = F.col("p"), F.col("q")
    sides = sides.withColumn("m", F.when(F.col("even") & (F.col("total") != 0), F.zip_with(
        p["mean"], q["mean"],
        lambda a, b: (p["total"] * a - q["total"] * b) / F.col("total"),
    )))
    squares = F.transform(
        F.arrays_zip(
            F.col("m"), p["mean"].alias("a"), q["mean"].alias("b"),
            p["dev"].alias("c"), q["dev"].alias("d"),
        ),
        lambda x: (
            x["c"] + p["total"] * (x["a"] - x["m"]) * (x["a"] - x["m"])
            - x["d"] - q["total"] * (x["b"] - x["m"]) * (x["b"] - x["m"])
        ) / F.col("total"),
    )
    return sides.select(
        *keys, "vectors",
        F.transform("m", finite).alias("vec_mean"),
        F.transform(squares, lambda x: finite(F.sqrt(x))).alias("vec_std"),
    )
