"""Whitening of embeddings on the leading components of their covariance.

Entries become whole numbers first, so counts, sums and deviations are exact. Every distinct
vector counts once. Tasks reduce their vectors to one matrix of centred products; the matrix,
whose size is the vectors' width and not their number, is taken apart on the driver by
polar decompositions; the components go to the tasks, which project every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from rostrum.llm.polar import eigen
from rostrum.llm.registry import fresh
from rostrum.session import durable

STEP = 256  # whole numbers per unit of an entry
WIDEST = 4096  # entries of a vector: one matrix of this width is 128 MB on the driver
MOST = 4
BEYOND = 2.0 ** 62 / STEP
BATCH_ROWS = 8192


@dataclass
class Whitening:
    """n distinct vectors with sums S per entry; the components' unit vectors in columns,
    falling eigenvalues, the share of each in the trace (null: no trace)."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return len(self.sums)

    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]


def whole_entries(vector: Column) -> Column:
    """floor(256 * entry) of every entry; null where the vector is null or holds an entry that
    is null, not finite, or beyond 2^62 / 256."""
    sound = F.forall(vector, lambda c: F.coalesce(
        ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < BEYOND), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * STEP)))


def common_width(rows: DataFrame, x: str) -> int:
    """The most frequent width, the larger one on ties; 0 without rows or entries."""
    widths = rows.where(F.col(x).isNotNull()).groupBy(F.size(x).alias("w")).agg(F.count("*").alias("n"))
    most = widths.orderBy(F.desc("n"), F.desc("w")).first()
    width = most["w"] if most else 0
    if width > WIDEST:
        raise ValueError(f"vectors of {width} entries; the covariance is kept up to {WIDEST}")
    return width


def _matrix(batch: pa.Array, width: int) -> np.ndarray:
    return batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sums_of(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Exact count and sums per entry, added in two halves so that nothing overflows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()),
             pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    total = fit.mapInArrow(run, "i int, n bigint, high bigint, low bigint").groupBy("i").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    ).orderBy("i").collect()  # a row per entry
    return total[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in total]


class Centre:
    """Vectors less their mean S / n, from whole quotients and remainders of S by n."""

    def __init__(self, n: int, sums: list[int]):
        parts = [divmod(s, n) for s in sums]
        self.n = n
        self.quotient = np.array([q for q, _ in parts], np.int64)
        self.rest = np.array([r for _, r in parts], object)
        self.fraction = np.array([r / n for _, r in parts])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.quotient).astype(float) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)^2; null beyond a long."""
        gap = x - self.quotient
        largest = max(int(np.abs(gap).max(initial=0)), 1) + 1
        if (largest * self.n) ** 2 * max(x.shape[1], 1) < 1 << 63:
            scaled = gap * self.n - self.rest.astype(np.int64)
            return (scaled * scaled).sum(axis=1).tolist()
        scaled = gap.astype(object) * self.n - self.rest
        exact = [int(v) for v in (scaled * scaled).sum(axis=1)]
        return [v if v < 1 << 63 else None for v in exact]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Centred products over n. A task adds up one matrix; their rows are added by row number."""
    width, centre = len(sums), Centre(n, sums)
    kind, columns = pa.list_(pa.float64()), ["i", "row"]
    schema = "i int, row array<double>"

    def rows(i, m) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(list(m), kind)], columns)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                c = centre.centred(_matrix(batch.column(0).slice(at, BATCH_ROWS), width))
                total += c.T @ c
                seen = True
        if seen:
            yield rows(range(width), total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), width)):
                total[i] = total[i] + row if i in total else row.copy()
        if total:
            yield rows(list(total), total.values())

    out = np.zeros((width, width))
    # As many rows as a vector has entries.
    for r in fit.mapInArrow(products, schema).repartition("i").mapInArrow(added, schema).collect():
        out[r["i"]] = r["row"]
    return (out + out.T) / 2 / n


def _projected(x: Column, model: Whitening) -> Column:
    """Deviation and whitened values of whole-number vectors."""
    centre, width = Centre(model.n, model.sums), model.width
    positive = model.values > 0
    scale = np.where(positive, 1 / np.sqrt(np.where(positive, model.values, 1.0)), np.nan)
    matrix = model.vectors * scale
    kind = pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    @arrow_udf("struct<deviation: bigint, whitened: array<double>>")
    def project(x: pa.Array) -> pa.Array:
        there = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
        out: list = [None] * len(x)
        if len(there):
            entries = _matrix(x.drop_null(), width)
            for i, d, w in zip(there, centre.deviations(entries), centre.centred(entries) @ matrix):
                out[i] = {"deviation": d, "whitened": [v if v == v else None for v in w.tolist()]}
        return pa.array(out, kind)

    return project(x)


def fit(rows: DataFrame, x: str, most: int = MOST) -> Whitening | None:
    """The leading components of the distinct vectors in `x`, by the polar method; None without
    any. All vectors have the same width. Their list is written once."""
    distinct = durable(rows.select(F.col(x).alias("x")).where(F.col(x).isNotNull()).distinct(), "vectors")
    first = distinct.first()
    if first is None:
        return None
    width = len(first["x"])
    n, sums = sums_of(distinct, width)
    v = covariance(distinct, n, sums)
    _, vectors = eigen(v)
    vectors, trace = vectors[:, :most], float(np.trace(v))
    k = vectors.shape[1]
    # The variance along a component is finer than the matrix can tell beside larger ones.
    plain = _moments(distinct, Whitening(n, sums, vectors, np.ones(k), trace), [(i, i) for i in range(k)])
    values = np.array([plain[i, i] for i in range(k)])
    # What rounding leaves of a component without spread is none.
    values = np.where(values > (4 * width * np.finfo(float).eps) ** 2 * trace, values, 0.0)
    order = np.argsort(-values, kind="stable")
    model = Whitening(n, sums, vectors[:, order], values[order], trace)
    spread = [i for i in range(k) if model.values[i] > 0]
    if spread:
        found = _moments(distinct, model, [(i, j) for i in spread for j in spread if i <= j])
        model.identity_error = max(abs(c - (i == j)) for (i, j), c in found.items())
    return model


def _moments(distinct: DataFrame, model: Whitening, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Covariances of pairs of whitened values, centred and merged as they are added up."""
    white = distinct.select(_projected(F.col("x"), model)["whitened"].alias("w"))
    found = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"{i}_{j}") for i, j in pairs]).first()
    return {(i, j): found[f"{i}_{j}"] for i, j in pairs}


def whiten(df: DataFrame, vector: str = "embedding", most: int = MOST) -> tuple[DataFrame, Whitening | None, list[str]]:
    """`df` without rows whose vector cannot be used, with `deviation` and `whitened` (up to
    `most` values) in columns whose names are returned, and the model they come from.

    Left out are vectors that are null, hold null or non-finite entries or entries beyond
    2^62 / 256, and those of another width than the most frequent one (the larger on ties).
    Empty vectors have no component; if they are the most frequent, they come back with empty
    `whitened` and no model. Rows that repeat come back each and count once in the fit.
    Without spread in a component its values are null; a deviation beyond a long is null.
    Equal eigenvalues leave their components' choice open. New names get underscores if taken.
    """
    x, deviation, whitened = fresh(df, "x_", "deviation", "whitened")
    rows = df.withColumn(x, whole_entries(F.col(f"`{vector}`"))).where(F.col(x).isNotNull())
    width = common_width(rows, x)
    rows = rows.where(F.size(x) == width)
    model = fit(rows, x, most) if width else None
    if model is None:
        columns = {deviation: F.lit(0).cast("bigint"), whitened: F.array().cast("array<double>")}
        return rows.withColumns(columns).select(*df.columns, *columns), None, [deviation, whitened]
    both, = fresh(rows, "both_")
    rows = rows.withColumn(both, _projected(F.col(x), model)).select(
        *[F.col(f"`{c}`") for c in df.columns], F.col(both)["deviation"].alias(deviation),
        F.col(both)["whitened"].alias(whitened),
    )
    return rows, model, [deviation, whitened]
