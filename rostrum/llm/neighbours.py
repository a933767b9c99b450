"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors is joined to a neighbour graph; the graph is cut into
parts of equal size with few edges between them; a small network learns which parts hold
a point's neighbours. Every row lies in its most probable part; a query visits its
most probable parts, as many as bring the sample's own queries to the wanted recall, and
what lies there is ranked by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rostrum.session import durable

SAMPLE_ROWS = 8192
PARTS = 16
ROWS_PER_PART = 1 << 17  # beyond PARTS times this, there are more parts
MOST_PARTS = 1024
NEIGHBOURS = 10
HIDDEN = 64
EPOCHS = 40
TARGET_RECALL = 0.95  # of the sample's held-back queries
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024


@dataclass
class Router:
    """Two layers: log-probabilities of the parts. `probes`: parts a query visits."""

    centre: np.ndarray
    layers: list[np.ndarray]
    probes: int

    @property
    def parts(self) -> int:
        return self.layers[-1].shape[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.centre) @ w1 + b1, 0) @ w2 + b2


def knn(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), max(k, 0)), np.int64)
    square = (x * x).sum(axis=1)
    for at in range(0, len(x), 1024):
        part = x[at:at + 1024]
        d = square[None, :] - 2 * part @ x.T
        d[np.arange(len(part)), at + np.arange(len(part))] = np.inf
        out[at:at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Cut the graph into parts of at most 5 % over the mean: halve along the widest
    direction, again and again, then let vertices move to the part of most neighbours."""
    n = len(x)
    label = np.zeros(n, np.int64)
    groups, rng = [np.arange(n)], np.random.default_rng(seed)
    while len(groups) < parts:
        groups.sort(key=len)
        own = groups.pop()
        v = rng.normal(size=x.shape[1])
        z = x[own] - x[own].mean(axis=0)
        for _ in range(8):  # power iteration
            v = z.T @ (z @ v)
            v /= np.linalg.norm(v) or 1.0
        order = own[np.argsort(z @ v, kind="stable")]
        groups += [order[:len(order) // 2], order[len(order) // 2:]]
    for i, own in enumerate(groups):
        label[own] = i
    most = int(np.ceil(1.05 * n / parts))
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], 1),
                           np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])], 1)])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (both[:, 0], label[both[:, 1]]), 1.0)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < n // 200:
            break
    return label


def train(x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> list[np.ndarray]:
    """Cross entropy on soft targets, by Adam on small batches."""
    rng = np.random.default_rng(seed)
    d, m = x.shape[1], target.shape[1]
    p = [rng.normal(size=(d, hidden)) * np.sqrt(2 / d), np.zeros(hidden),
         rng.normal(size=(hidden, m)) * np.sqrt(1 / hidden), np.zeros(m)]
    mean, var, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at:at + 256]
            a, t = x[rows], target[rows]
            h = np.maximum(a @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            e = (z / z.sum(axis=1, keepdims=True) - t) / len(rows)
            back = (e @ p[2].T) * (h > 0)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], e.sum(axis=0)]
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for i, g in enumerate(grads):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                var[i] = 0.999 * var[i] + 0.001 * g * g
                p[i] = p[i] - rate * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(var[i] / (1 - 0.999 ** step)) + 1e-8)
    return p


def fit_router(x: np.ndarray, parts: int, recall: float = TARGET_RECALL, k: int = NEIGHBOURS) -> Router:
    """Partition, train and calibrate on the sample; a fifth of it only asks."""
    parts = max(1, min(parts, len(x) // 16))
    centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    if parts == 1:
        d = x.shape[1]
        return Router(centre, [np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    graph = knn(x, k)
    label = balanced_parts(graph, x, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(x)), label] += 1.0
    target /= target.sum(axis=1, keepdims=True)
    asks = np.arange(len(x)) % 5 == 0
    router = Router(centre, train((x - centre)[~asks], target[~asks]), parts)
    home = router.scores(x).argmax(axis=1)
    order = np.argsort(-router.scores(x[asks]), axis=1, kind="stable")
    where = home[graph[asks]]
    found = [np.mean((order[:, None, :p] == where[:, :, None]).any(axis=2)) for p in range(1, parts + 1)]
    router.probes = int(next(p for p, f in enumerate(found, 1) if f >= recall))
    return router


def usable(vector: Column) -> Column:
    """Not null, not all zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def _routed(rows: DataFrame, router: Router, counts: np.ndarray | None, least: int) -> DataFrame:
    """`(id, vector, part)`: the most probable part, or - with the parts' row counts - all
    parts a query visits: `probes` of them, and more until `least` rows lie there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = router.scores(_matrix(batch.column(1)))
            order = np.argsort(-score, axis=1, kind="stable")
            if counts is None:
                at, part = np.arange(len(order)), order[:, 0]
            else:
                before = np.cumsum(counts[order], axis=1) - counts[order]
                visit = (np.arange(order.shape[1])[None, :] < router.probes) | (before < least)
                at, which = np.nonzero(visit)
                part = order[at, which]
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(part.astype(np.int32))], ["id", "vector", "part"]
            )

    return rows.mapInArrow(run, "id bigint, vector array<double>, part int")


def _nearest(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of a block for each query of a block, by exact distance."""
    out = []
    if rows.num_rows and queries.num_rows:
        ids, x = rows["id"].to_numpy(), _matrix(rows["vector"])
        asks, q = queries["id"].to_numpy(), _matrix(queries["vector"])
        rough = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * q @ x.T
        # The rough distance is off by rounding only: what is within it of the k-th stays in.
        slip = 1e-9 * ((q * q).sum(axis=1).max() + (x * x).sum(axis=1).max())
        rough[asks[:, None] == ids[None, :]] = np.inf
        for i in range(len(asks)):
            r = rough[i]
            limit = np.partition(r, k - 1)[k - 1] if len(r) > k else np.inf
            near = np.flatnonzero((r <= limit + slip) & (r < np.inf))
            exact = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], exact))[:k]
            out.append((np.full(len(best), asks[i]), ids[near[best]], exact[best]))
    cells = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
    return pa.table({
        "query_id": pa.array(cells[0], pa.int64()), "vec_id": pa.array(cells[1], pa.int64()),
        "score": pa.array(cells[2], pa.float64()),
    })


def search(vectors: DataFrame, queries: Column, k: int = NEIGHBOURS, id_column: str = "vec_id",
           vector: str = "embedding", parts: int = PARTS, sample: int = SAMPLE_ROWS) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the k nearest rows found for every row where
    `queries` holds, by Euclidean distance in double precision, ties to the smaller id.

    Rows with the query's own id are no candidates. Vectors that are null, zero, hold null
    or non-finite components or are not as wide as most of the sample take no part, nor
    do rows without an id. A query's id that repeats asks with its least vector; a
    candidate that repeats is found as often. With fewer than k candidates all are found.
    Rows and queries of a part meet in blocks, so a part may hold any share of the rows.
    """
    rows = vectors.where(F.col(f"`{id_column}`").isNotNull() & usable(F.col(f"`{vector}`"))).select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"), queries.alias("asks"),
    )
    drawn = rows.orderBy(F.xxhash64("id", "vector"), "id").select("vector").limit(sample).toArrow()["vector"]
    widths = np.array([len(v) for v in drawn], np.int64)
    width = int(np.bincount(widths).argmax()) if len(widths) else 0
    fitting = [v.values.to_numpy() for v in drawn if len(v.values) == width]
    x = np.array(fitting) if fitting else np.empty((0, width))
    rows = rows.where(F.size("vector") == width)
    total = rows.count()
    router = fit_router(x, min(MOST_PARTS, max(parts, total // ROWS_PER_PART)))

    indexed = durable(_routed(rows.select("id", "vector"), router, None, 0), "indexed")
    counts = np.zeros(router.parts, np.int64)
    for r in indexed.groupBy("part").count().collect():  # a row per part
        counts[r["part"]] = r["count"]
    asked = rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    visits = durable(_routed(asked, router, counts, k + 1), "visits")
    asks = np.zeros(router.parts, np.int64)
    for r in visits.groupBy("part").count().collect():
        asks[r["part"]] = r["count"]
    row_blocks, ask_blocks = (
        F.array(*[F.lit(int(max(1, -(-c // size)))) for c in n])
        for n, size in ((counts, BLOCK_ROWS), (asks, BLOCK_QUERIES))
    )
    own = lambda blocks: F.pmod(F.xxhash64("id", "vector"), F.get(blocks, F.col("part"))).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("part")) - 1))
    keys = ["part", "row_block", "ask_block"]
    left = indexed.withColumn("row_block", own(row_blocks)).withColumn("ask_block", every(ask_blocks))
    right = visits.withColumn("ask_block", own(ask_blocks)).withColumn("row_block", every(row_blocks))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda a, b: _nearest(a, b, k), "query_id bigint, vec_id bigint, score double"
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
