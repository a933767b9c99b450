"""Pearson correlations over many column pairs in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rostrum.functions.numeric import mask_small

TILE = 256  # columns of a block; a task holds four matrices of two blocks

PARTIAL = (
    "i int, j int, n double, li double, lj double, mi double, mj double, "
    "cii double, cjj double, cij double"
)


def _partial(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Sums per task and pair, reading only the columns of these pairs."""
    used = sorted({i for p in pairs for i in p})
    at = {i: k for k, i in enumerate(used)}
    numbers = np.array(used, "int32")
    left = np.array([at[a] for a, _ in pairs])
    right = np.array([at[b] for _, b in pairs])

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level = None
        for batch in batches:
            x = batch.to_numpy(dtype="float64", na_value=np.nan)
            ok = np.isfinite(x)
            if level is None:
                first = ok.argmax(axis=0)
                level = np.where(ok.any(axis=0), x[first, np.arange(x.shape[1])], 0.0)
                n = sx = sxx = sxy = np.zeros((x.shape[1], x.shape[1]))
            d = np.where(ok, x - level, 0.0)
            seen = ok.astype("float64")
            n = n + seen.T @ seen
            sx = sx + d.T @ seen
            sxx = sxx + (d * d).T @ seen
            sxy = sxy + d.T @ d
        if level is None:
            return
        count = n[left, right]
        a, b = sx[left, right], sx[right, left]
        with np.errstate(all="ignore"):
            out = pd.DataFrame({
                "i": numbers[left], "j": numbers[right], "n": count,
                "li": level[left], "lj": level[right], "mi": a / count, "mj": b / count,
                "cii": sxx[left, right] - a * a / count,
                "cjj": sxx[right, left] - b * b / count,
                "cij": sxy[left, right] - a * b / count,
            })
        yield out[count > 0]

    rows = df.select(*[F.col(f"`{columns[i]}`").cast("double").alias(f"c{k}") for i, k in at.items()])
    return rows.mapInPandas(partial_sums, PARTIAL)


def correlations(
    df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]], tile: int = TILE
) -> DataFrame:
    """`(a, b, n, r)` per pair, over the rows where both values are finite.

    Each task turns its rows into sums over all pairs (four matrix products per
    Arrow batch) and passes on one row per pair, so the shuffle holds
    tasks x pairs rows however large the table is. Sums are taken around the
    task's own level and merged around the common mean, which keeps far-off means
    from drowning the deviations. A constant column has no coefficient.

    Pairs of more than `tile` columns are worked on block by block of columns: a task then
    holds matrices of two blocks, whatever the number of columns, and reads only those.
    """
    columns = list(columns)
    at = {c: k for k, c in enumerate(columns)}
    blocks: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b in pairs:
        i, j = at[a], at[b]
        key = tuple(sorted((i // tile, j // tile))) if len(columns) > tile else (0, 0)
        blocks.setdefault(key, []).append((i, j))
    partial = reduce(DataFrame.unionAll, [_partial(df, columns, block) for block in blocks.values()])
    pair = W.partitionBy("i", "j")
    n, di, dj = F.col("n"), F.col("mi") - F.col("gi"), F.col("mj") - F.col("gj")
    total = F.sum("n").over(pair)
    # Task means relative to the least level of the pair keep all their digits.
    merged = partial.withColumns({
        "mi": F.col("li") - F.min("li").over(pair) + F.col("mi"),
        "mj": F.col("lj") - F.min("lj").over(pair) + F.col("mj"),
    }).withColumns({
        "gi": F.sum(n * F.col("mi")).over(pair) / total,
        "gj": F.sum(n * F.col("mj")).over(pair) / total,
    }).groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.sum(F.greatest(F.col("cii"), F.lit(0.0)) + n * di * di).alias("cii"),
        F.sum(F.greatest(F.col("cjj"), F.lit(0.0)) + n * dj * dj).alias("cjj"),
        F.sum(F.col("cij") + n * di * dj).alias("cij"),
        F.max(F.abs("li") + F.abs("gi")).alias("si"),
        F.max(F.abs("lj") + F.abs("gj")).alias("sj"),
    )

    def varies(dev: str, size: str) -> Column:
        # Anything below is rounding noise of a constant.
        noise = F.col(size) * 1e-14
        return F.col(dev) > F.col("n") * noise * noise

    r = F.col("cij") / F.sqrt("cii") / F.sqrt("cjj")
    names = F.array(*[F.lit(c) for c in columns])
    return merged.select(
        F.get(names, "i").alias("a"), F.get(names, "j").alias("b"),
        F.col("n").cast("bigint").alias("n"),
        F.when(varies("cii", "si") & varies("cjj", "sj"),
               F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
    )


def corr_matrix(df: DataFrame, columns: Sequence[str], tile: int = TILE) -> DataFrame:
    """Every unordered pair of columns once."""
    return correlations(df, columns, list(combinations(columns, 2)), tile)


def corr_long(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """The left x right rectangle in long form."""
    columns = list(dict.fromkeys([*left, *right]))
    return correlations(df, columns, list(product(left, right)))


def corr_table(
    df: DataFrame, left: Sequence[str], right: Sequence[str], threshold: float = 0.0
) -> DataFrame:
    """The rectangle as text, one row per left column, weak coefficients as `-`."""
    long = corr_long(df, left, right)
    wide = long.groupBy("a").agg(*[
        F.max(F.when(F.col("b") == name, mask_small("r", threshold))).alias(name)
        for name in right
    ])
    order = F.array_position(F.array(*[F.lit(c) for c in left]), F.col("a"))
    return wide.orderBy(order)


def corr_rank(df: DataFrame, features: Sequence[str], metric: str) -> DataFrame:
    """Features by the strength of their correlation with one metric."""
    ranked = corr_long(df, features, [metric]).select(F.col("a").alias("feature"), "n", "r")
    return ranked.orderBy(F.abs("r").desc_nulls_last(), "feature")
