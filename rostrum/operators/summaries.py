"""Counts, histograms, cohorts, joins on cleaned keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rostrum.functions.numeric import finite
from rostrum.functions.ratings import top_names
from rostrum.functions.text import join_key
from rostrum.vocab import COHORT_SIZE


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value (or combination), the most frequent first."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


MOST_TRACKED = 1 << 14  # values a sketch keeps


def most_common(df: DataFrame, column: str, k: int, tracked: int = MOST_TRACKED) -> DataFrame:
    """The k most frequent values, as `value_counts` gives them, NULL among them.

    A sketch of bounded size names candidates and a second pass counts them. What the sketch
    leaves out has fewer rows than its error, or than the last candidate's estimate; where the
    k-th count is not above both, the values are too even for it and all are counted.
    """
    c = F.col(f"`{column}`")
    candidates = min(4 * k, tracked)
    told = df.agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(`{column}`, {candidates}, {tracked})").alias("top")
    ).first()  # as many values as there are candidates
    found = [r["item"] for r in told["top"] or []]
    rows = df.where(c.isin(found) | c.isNull()) if found else df.where(c.isNull())
    counted = value_counts(rows.select(c.alias(column)), column).limit(k)
    everything = len(found) < candidates
    least = max(told["top"][-1]["count"] if found else 0, 3.5 * told["n"] / tracked)
    if not everything or 3.5 * told["n"] / tracked >= 1:
        counts = [r["n"] for r in counted.collect()]  # k rows
        if len(counts) < k or counts[-1] <= least:
            return value_counts(df.select(c.alias(column)), column).limit(k)
    return counted


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows per equal-width bin (0-based) between the column's least and greatest.

    The greatest value belongs to the last bin. With `by`, each group is counted
    over the same bins. Empty bins do not appear.
    """
    v = finite(value)
    rows = df.select(*by, v.alias("v")).where(F.col("v").isNotNull())
    span = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    place = F.floor((F.col("v") - lo) / (hi - lo) * bins)
    bin_ = F.when(hi == lo, 0).otherwise(F.least(place, F.lit(bins - 1))).cast("bigint")
    counted = rows.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select(
        *by, "bin",
        (lo + (hi - lo) * F.col("bin") / bins).alias("bin_start"),
        (lo + (hi - lo) * (F.col("bin") + 1) / bins).alias("bin_end"),
        "n",
    )


def histograms(df: DataFrame, columns: Sequence[str], bins: int, by: Sequence[str] = ()) -> DataFrame:
    """`histogram` of several columns, under `name`. One pass finds the ends of all columns and
    one counts; how many columns there are changes neither."""
    values = [finite(f"`{c}`").cast("double") for c in columns]
    ends = df.agg(F.array(*[
        F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")) for v in values
    ]).alias("ends")).scalar()
    cells = F.array(*[F.struct(F.lit(c).alias("name"), v.alias("v")) for c, v in zip(columns, values)])
    long = df.select(*by, F.inline(F.arrays_zip(cells, ends)).alias("cell", "ends")).select(
        *by, "cell.*", "ends.*"
    ).where(F.col("v").isNotNull())
    lo, hi, width = F.col("lo"), F.col("hi"), F.col("hi") - F.col("lo")
    place = F.floor(F.try_divide(F.col("v") - lo, width) * bins)
    bin_ = F.when(hi == lo, 0).otherwise(F.least(place, F.lit(bins - 1))).cast("bigint")
    counted = long.groupBy(*by, "name", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select(
        *by, "name", "bin", (lo + width * F.col("bin") / bins).alias("bin_start"),
        (lo + width * (F.col("bin") + 1) / bins).alias("bin_end"), "n",
    )


def tops_contain(df: DataFrame, ratings: str, names: Sequence[str], k: int) -> DataFrame:
    """For each name, under `rating`, the rows whose k largest ratings include it and the others,
    counted in one pass. A side without rows does not appear."""
    top = df.select(top_names(ratings, k).alias("top"))
    holds = [F.coalesce(F.array_contains("top", n), F.lit(False)) for n in names]
    counts = top.agg(F.count("*").alias("all"), *[F.count_if(h).alias(f"n{i}") for i, h in enumerate(holds)])
    sides = [F.struct(F.lit(name).alias("rating"), F.lit(side).alias("side"), n.alias("n"))
             for i, name in enumerate(names)
             for side, n in (("positive", F.col(f"n{i}")), ("negative", F.col("all") - F.col(f"n{i}")))]
    return counts.select(F.inline(F.array(*sides))).where("n > 0")


def top_contains(df: DataFrame, ratings: str, name: str, k: int) -> DataFrame:
    """Rows whose k largest ratings include `name`, against those without."""
    holds = F.array_contains(top_names(ratings, k), name)
    return df.groupBy(
        F.when(holds, "positive").otherwise("negative").alias("side")
    ).agg(F.count("*").alias("n"))


def top_rows(df: DataFrame, metric: str, key: str, n: int = COHORT_SIZE) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(metric), F.asc(key)).limit(n)


def bottom_rows(df: DataFrame, metric: str, key: str, n: int = COHORT_SIZE) -> DataFrame:
    """The last n rows of the order of `top_rows`: rows without a metric come first."""
    return df.orderBy(F.asc_nulls_first(metric), F.desc(key)).limit(n)


def cohorts(df: DataFrame, metric: str, key: str, n: int = COHORT_SIZE) -> DataFrame:
    """Both ends, marked `most` and `least` in `rank`; with fewer than 2n rows a row
    can be in both."""
    most = top_rows(df, metric, key, n).withColumn("rank", F.lit("most"))
    least = bottom_rows(df, metric, key, n).withColumn("rank", F.lit("least"))
    return most.unionByName(least)


def join_on_text(
    left: DataFrame, right: DataFrame, key: str, null_as_text: bool = False
) -> DataFrame:
    """Inner join on a stripped key. AQE picks the strategy and splits skewed keys.

    `null_as_text` joins every row without a key to every other such row: leave it off
    unless one side has few of them.
    """
    return left.withColumn(key, join_key(key, null_as_text)).join(
        right.withColumn(key, join_key(key, null_as_text)), key, "inner"
    )


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of `left` without a partner on the stripped key."""
    clean = left.withColumn(key, join_key(key))
    return clean.join(right.select(join_key(key).alias(key)), key, "left_anti")


def drop_incomplete(
    df: DataFrame, columns: Sequence[str] | None = None, csv_parity: bool = False
) -> DataFrame:
    """Keep rows where no column is missing. NaN and infinity count as missing in
    number columns; with `csv_parity` empty text does as well."""
    def missing(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            return finite(c).isNull()
        if kind == "string" and csv_parity:
            return c.isNull() | (c == "")
        return c.isNull()

    chosen = set(columns or df.columns)
    # One predicate over an array: hundreds of separate ones cost the optimizer
    # far more time than the rows cost the cluster.
    flags = F.array(*[missing(n, k) for n, k in df.dtypes if n in chosen])
    return df.where(~F.array_contains(flags, True))
