"""Global z-scores: one aggregate row, read back as a scalar subquery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rostrum.functions.numeric import finite, ratio


def moments(df: DataFrame, columns: Sequence[str], ddof: int = 1) -> Column:
    """Mean and standard deviation of all columns as one struct value.

    One pass with partial aggregation; what comes back is a single row, whatever
    the size of `df`. Rows missing a value are skipped for that column only.
    """
    std = {0: F.stddev_pop, 1: F.stddev_samp}[ddof]
    row = df.agg(F.struct(*[
        F.struct(
            F.avg(finite(f"`{c}`")).alias("mean"), std(finite(f"`{c}`")).alias("std")
        ).alias(c)
        for c in columns
    ]).alias("moments"))
    return row.scalar()


def zscore(
    df: DataFrame, columns: dict[str, str] | Sequence[str], ddof: int = 1
) -> DataFrame:
    """Add z-scores of `columns` (a list, or a mapping of column to new name).

    `ddof` picks the sample (1) or population (0) deviation; a constant column
    gets NULL.
    """
    names = columns if isinstance(columns, dict) else {c: f"{c}_norm" for c in columns}
    # As a column of its own the row of moments is one subquery for all z-scores.
    stats = F.col("_moments")
    return df.withColumn("_moments", moments(df, list(names), ddof)).withColumns({
        new: ratio(
            finite(f"`{c}`") - stats.getField(c).getField("mean"),
            stats.getField(c).getField("std"),
        )
        for c, new in names.items()
    }).drop("_moments")
