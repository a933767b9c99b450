"""Principal components of wide vectors, without a matrix of width by width.

A block of random directions is sent through the table a few times; the directions of all
rounds span the space the components are taken from (block Krylov). What a task gives
back is as wide as the vectors and as long as a block; the last pass gives one small triangle
per task (QR), and triangles are folded in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from rostrum.operators.models import standardise
from rostrum.vocab import SEED

OVERSAMPLE = 8
ROUNDS = 6
BLOCK = 1024  # rows at a time
TRIANGLES = 32  # at most, on the driver


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            yield whole.slice(at, BLOCK).column(0).flatten().to_numpy().reshape(-1, width)


def _through(rows: DataFrame, directions: np.ndarray) -> np.ndarray:
    """X'X times the directions; one sum per position and direction."""
    names = [f"s{c}" for c in range(directions.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(directions.shape)
        for x in _blocks(batches, len(directions)):
            total += x.T @ (x @ directions)
        at = pa.array(np.arange(len(total), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([at, *map(pa.array, total.T)], ["at", *names])

    sums = rows.mapInArrow(run, ", ".join(["at int", *[f"{n} double" for n in names]])).groupBy("at").agg(
        *[F.sum(n).alias(n) for n in names])
    out = np.zeros(directions.shape)
    for r in sums.collect():  # a row per position
        out[r["at"]] = [r[n] for n in names]
    return out


def _triangle(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """R of the QR factors of the rows seen in the basis."""
    size = basis.shape[1]

    def fold(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for part in parts:
            r = np.linalg.qr(np.vstack([r, part]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], ["r"])

    first = rows.mapInArrow(
        lambda batches: fold(x @ basis for x in _blocks(batches, len(basis))), "r array<double>")
    second = first.repartition(TRIANGLES).mapInArrow(
        lambda batches: fold(v.values.to_numpy().reshape(-1, size) for b in batches for v in b.column(0)),
        "r array<double>")
    parts = [np.array(r["r"]).reshape(-1, size) for r in second.collect()]
    return np.linalg.qr(np.vstack([np.zeros((1, size)), *parts]), mode="r")


def loadings(
    rows: DataFrame, width: int, k: int = 2, oversample: int = OVERSAMPLE, rounds: int = ROUNDS,
    seed: int = SEED,
) -> np.ndarray:
    """The k leading components of the rows (one array column, centred), a column each and
    at most `width` of them; in each the loading of largest size is positive. Exact where
    `(rounds + 1) * (k + oversample)` reaches the width."""
    random = np.random.default_rng(seed)
    block = np.linalg.qr(random.standard_normal((width, min(width, k + oversample))))[0]
    basis = block
    for _ in range(rounds):
        if basis.shape[1] == width:
            break
        block = _through(rows, block)
        block /= max(np.linalg.norm(block), 1e-300)
        for _ in range(2):  # twice is enough
            block -= basis @ (basis.T @ block)
        # Directions that the basis has already give way to new random ones.
        spare = random.standard_normal(block.shape) * 1e-14
        block = np.linalg.qr(block + spare - basis @ (basis.T @ spare))[0][:, :width - basis.shape[1]]
        basis = np.linalg.qr(np.hstack([basis, block]))[0]
        block = basis[:, -block.shape[1]:]
    out = basis @ np.linalg.svd(_triangle(rows, basis))[2][:k].T
    return out * np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])


def project(df: DataFrame, vector: str, directions: np.ndarray, names: Sequence[str]) -> DataFrame:
    """Replace array column `vector` by its products with the directions; a null vector has none."""
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v) @ directions for v in x], dtype=object)

    seen = df.withColumn(vector, run(F.col(f"`{vector}`")))
    return seen.select(*[f"`{c}`" for c in df.columns if c != vector], *[
        F.get(F.col(f"`{vector}`"), F.lit(i)).alias(n) for i, n in enumerate(names)])


def wide_components(
    df: DataFrame, vector: str, k: int = 2, oversample: int = OVERSAMPLE, rounds: int = ROUNDS,
    seed: int = SEED,
) -> DataFrame:
    """`principal_components` for vectors of many thousand positions: `pc1..pck` of the
    standardised vectors, in place of `vector`. An empty table stays empty; components
    beyond the width are null."""
    names = [f"pc{i + 1}" for i in range(k)]
    row = df.agg(F.max(F.size(F.col(f"`{vector}`")))).first()
    if row[0] is None:
        return project(df, vector, np.zeros((0, k)), names)
    (scaled,), _ = standardise(df, [], vector)
    scaled = scaled.withColumn(vector, vector_to_array(vector))
    kept = scaled.select(vector).persist()
    try:
        found = loadings(kept, row[0], k, oversample, rounds, seed)
    finally:
        kept.unpersist()
    return project(scaled.select(*df.columns), vector, found, names)
