"""Global positions, first-appearance codes and fold numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rostrum.functions.numeric import col
from rostrum.session import durable
from rostrum.vocab import FOLDS, SEED


def hash_number(key: Column | str, seed: int = SEED, digits: int = 8) -> Column:
    """The first hex digits of an MD5 of key and seed, as a whole number."""
    text = F.concat(col(key).cast("string"), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def with_position(
    df: DataFrame, order: str, ties: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Add the 0-based rank by column `order` (then `ties`).

    Rows are dealt out by range of (order, ties) from a sample, so neither an outlier nor
    a frequent value gathers them in one task; each range is ranked on its own and moved
    up by the rows in the ranges before it. The ranges are written once, since a range
    must not change between counting and ranking. Only their counts, one row per task,
    are ordered in one task and broadcast.
    """
    ranged = df.repartitionByRange(col(order), *[F.col(t) for t in ties]).withColumn(
        "_range", F.spark_partition_id()
    )
    ranged = durable(ranged, "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        "_range",
        F.coalesce(F.sum("_n").over(
            W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        ), F.lit(0)).alias("_before"),
    )
    within = W.partitionBy("_range").orderBy(order, *ties)
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_before") + F.row_number().over(within) - 1)
        .drop("_range", "_before")
    )


def appearance_codes(df: DataFrame, value: str, row_key: str, name: str = "code") -> DataFrame:
    """Distinct values with a 0-based code by first appearance (least `row_key`).

    `row_key` is a whole number, unique per row. A missing value counts as one.
    """
    first = df.groupBy(value).agg(F.min(row_key).alias("first_key"))
    return with_position(first, "first_key", name=name)


def add_appearance_code(df: DataFrame, value: str, row_key: str, name: str) -> DataFrame:
    """Add the first-appearance code of a column to every row."""
    codes = appearance_codes(df, value, row_key, name).select(F.col(value).alias("_value"), name)
    return df.join(codes, F.col(value).eqNullSafe(F.col("_value")), "left").drop("_value")


def hash_folds(
    df: DataFrame, key: str, folds: int = FOLDS, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Fold number from the row's key alone: no shuffle, and stable under any
    partitioning. Fold sizes differ by chance."""
    return df.withColumn(name, hash_number(key, seed) % folds)


def balanced_folds(
    df: DataFrame, key: str, folds: int = FOLDS, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Fold numbers in hash order whose sizes differ by one at most, larger ones first."""
    n = df.agg(F.count("*")).scalar()
    size, extra = F.floor(n / folds), n % folds
    ranked = with_position(
        df.withColumn("_hash", hash_number(key, seed)), "_hash", [key], "_position"
    )
    place = F.col("_position")
    head = extra * (size + 1)
    fold = F.when(place < head, F.floor(place / (size + 1))).otherwise(
        extra + F.floor((place - head) / F.greatest(size, F.lit(1)))
    )
    return ranked.withColumn(name, fold.cast("bigint")).drop("_hash", "_position")


def holdout(
    df: DataFrame, key: str, percent: int = 20, seed: int = SEED, name: str = "is_test"
) -> DataFrame:
    """Mark about `percent` of the rows as test rows, by key hash."""
    return df.withColumn(name, (hash_number(key, seed) % 100 < percent))
