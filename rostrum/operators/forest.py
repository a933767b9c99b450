"""A random forest whose nodes stay in the cluster.

Spark ML's forest goes over all rows for every group of nodes and gathers all nodes on the
driver; trees that grow until their leaves are pure have more nodes the more rows there are.
Here only nodes of more than `group_rows` rows are split by passes over the table. What is
below them is shuffled by node, and a task grows one such part at a time and lets the test
rows that fall into it vote. The driver holds the upper nodes alone.

Each row's draws and each node's positions follow from hashes, so neither partitions nor
`group_rows` change a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rostrum.session import durable

BINS = 32
GROUP_ROWS = 1 << 15
UNIT = 1 << 40  # a whole vote: sums of whole numbers do not depend on their order
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 16.0)]))


def mix(h: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers (the finaliser of SplitMix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def draws(row_hash: np.ndarray, trees: int) -> np.ndarray:
    """How often each row is in each tree's bag: Poisson numbers of mean 1."""
    h = mix(row_hash[:, None] ^ mix(np.arange(trees, dtype=np.uint64))[None, :])
    return np.searchsorted(POISSON, (h >> np.uint64(11)) / float(1 << 53), side="right").astype(np.uint8)


def positions_for(names: np.ndarray, d: int, picked: int) -> np.ndarray:
    """Each node's positions to choose a split from, drawn by the node's name."""
    h = mix(names[:, None] ^ mix(np.arange(d, dtype=np.uint64))[None, :])
    return np.sort(np.argpartition(h, picked - 1, axis=1)[:, :picked], axis=1)


def children(names: np.ndarray) -> np.ndarray:
    return np.stack([mix(names ^ np.uint64(1)), mix(names ^ np.uint64(2))], axis=1).ravel()


def tally(x, row, y, w, at, picks, classes: int) -> np.ndarray:
    """Drawn rows by class, node, picked position and bin."""
    k, s = picks.shape
    cells = ((y[row].astype(np.int64) * k + at)[:, None] * s + np.arange(s)) * BINS + x[row[:, None], picks[at]]
    return np.bincount(
        cells.ravel(), np.repeat(w, s), classes * k * s * BINS).reshape(classes, k, s, BINS)


def best_splits(hist: np.ndarray, picks: np.ndarray, min_rows: int):
    """Per node the position and bin of least Gini impurity, and the class counts of both
    sides; the position is -1 where no split helps."""
    left = hist.cumsum(axis=3)
    whole = left[:, :, :1, -1:]
    left = left[..., :-1]
    right = whole - left
    n, nl, nr = whole.sum(axis=0), left.sum(axis=0), right.sum(axis=0)
    allowed = (nl >= max(min_rows, 1)) & (nr >= max(min_rows, 1))
    score = (left ** 2).sum(axis=0) / np.maximum(nl, 1) + (right ** 2).sum(axis=0) / np.maximum(nr, 1)
    score = np.where(allowed, score, -1.0).reshape(len(picks), -1)
    best = score.argmax(axis=1)
    helps = score.max(axis=1) > (whole ** 2).sum(axis=0)[:, 0, 0] / n[:, 0, 0] * (1 + 1e-12)
    node, (place, cut) = np.arange(len(picks)), np.divmod(best, BINS - 1)
    sides = np.stack([side[:, node, place, cut].T for side in (left, right)], axis=1)
    return np.where(helps, picks[node, place], -1), cut, sides


class Nodes:
    """Nodes as arrays: position, bin, number of the first child (-1: none), counts, name, depth."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, depth):
        self.name, self.counts = names, counts
        self.depth = np.broadcast_to(np.asarray(depth, dtype=np.int64), len(names)).copy()
        self.position, self.cut = (np.zeros(len(names), dtype=np.int64) for _ in range(2))
        self.child = np.full(len(names), -1)

    def may_split(self, depth: int, min_rows: int) -> np.ndarray:
        n = self.counts.sum(axis=1)
        return (self.counts.max(axis=1) < n) & (n >= 2 * min_rows) & (self.depth < depth)

    def split(self, node, position, cut, sides) -> np.ndarray:
        """Give nodes their splits where there is one; the numbers of the new nodes."""
        helps = position >= 0
        node, sides, first = node[helps], sides[helps], len(self.name)
        self.position[node], self.cut[node] = position[helps], cut[helps]
        self.child[node] = first + 2 * np.arange(len(node))
        new = Nodes(children(self.name[node]), sides.reshape(2 * len(node), sides.shape[-1]),
                    np.repeat(self.depth[node] + 1, 2))
        for part in ("name", "counts", "depth", "position", "cut", "child"):
            setattr(self, part, np.concatenate([getattr(self, part), getattr(new, part)]))
        return np.arange(first, len(self.name))

    def descend(self, x, row, at) -> np.ndarray:
        """The lowest node that each of the rows reaches from node `at`."""
        at, live = at.copy(), np.arange(len(at))
        while len(live := live[self.child[at[live]] >= 0]):
            n = at[live]
            at[live] = self.child[n] + (x[row[live], self.position[n]] > self.cut[n])
        return at

    def votes(self) -> np.ndarray:
        return np.rint(self.counts / np.maximum(self.counts.sum(axis=1), 1)[:, None] * UNIT).astype(np.int64)


def grow(x, y, w, name, depth: int, level: int, classes: int, picked: int, min_rows: int) -> Nodes:
    """The whole tree below a node, level by level."""
    tree = Nodes(np.array([name]), np.bincount(y, w, classes)[None, :], level)
    row, at, new = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), np.zeros(1, dtype=np.int64)
    while len(new := new[tree.may_split(depth, min_rows)[new]]):
        place = np.full(len(tree.name), -1)
        place[new] = np.arange(len(new))
        inside = place[at] >= 0
        row, at = row[inside], at[inside]
        found = []
        for start in range(0, len(new), 1024):  # bounds the memory
            some = new[start:start + 1024]
            here = np.flatnonzero((place[at] >= start) & (place[at] < start + 1024))
            picks = positions_for(tree.name[some], x.shape[1], picked)
            hist = tally(x, row[here], y, w[row[here]], place[at[here]] - start, picks, classes)
            found.append(best_splits(hist, picks, min_rows))
        new = tree.split(new, *(np.concatenate(f) for f in zip(*found)))
        at = tree.descend(x, row, at)
    return tree


def split_points(rows: DataFrame, d: int) -> list[np.ndarray]:
    """At most 31 values to split each position at: percentiles, or the midpoints of all its
    values if they are few. Only these values come back to the driver."""
    fractions = [i / BINS for i in range(1, BINS)]
    told = rows.agg(F.array(*[
        F.percentile_approx(F.get("x", F.lit(i)), fractions, 10000) for i in range(d)]).alias("at")).first()
    points = [np.unique(np.array(p or [], dtype=float)) for p in told["at"]]
    repeated = [i for i, p in enumerate(points) if len(p) < BINS - 1]
    if repeated:
        # Not posexplode: Spark would infer a filter on x from it, and so read x of rows left out before.
        values = rows.select(F.posexplode_outer("x").alias("pos", "v")).where(F.col("pos").isin(repeated)).distinct()
        few = values.groupBy("pos").agg(F.count("*").alias("n")).where(F.col("n") <= BINS)
        for r in values.join(F.broadcast(few), "pos").groupBy("pos").agg(
                F.sort_array(F.collect_list("v")).alias("v")).collect():
            values = np.array(r["v"], dtype=float)
            points[r["pos"]] = values[:-1] + np.diff(values) / 2
    return points


def binned(rows: DataFrame, points: list[np.ndarray], *others: str, finite: bool) -> DataFrame:
    """Vectors as one byte per position, the number of split points below."""
    kept = rows.select(*others).schema
    d = len(points)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            if len(x) != batch.num_rows * d or finite and not np.isfinite(x).all():
                raise ValueError(f"vectors must have {d} positions, finite ones for a fit")
            x = x.reshape(-1, d)
            out = np.empty(x.shape, dtype=np.uint8)
            for i, p in enumerate(points):
                out[:, i] = np.searchsorted(p, x[:, i], side="left")
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [blobs(out, np.arange(len(x) + 1))], [*others, "x"])

    return rows.mapInArrow(put, kept.add("x", "binary"))


def blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The rows of an array between bounds, as one binary value each."""
    values = np.ascontiguousarray(values)
    size = values.nbytes // len(values) if len(values) else 0
    offsets = pa.array(bounds * size, pa.int32())
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, offsets.buffers()[1], pa.py_buffer(values)])


def pieces(batches: Iterator[pa.RecordBatch], trees: int, d: int) -> Iterator[tuple]:
    """Vectors, and the batch they are in, in pieces whose (row, tree) pairs fit in memory."""
    most = max(1, (1 << 26) // (trees * d))
    for whole in batches:
        for start in range(0, whole.num_rows, most):
            batch = whole.slice(start, most)
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.uint8)
            yield x.reshape(-1, d), batch


def number(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def upper_nodes(
    train: DataFrame, nodes: Nodes, trees: int, d: int, classes: int, depth: int, picked: int,
    min_rows: int, group_rows: int, memory_mb: int,
) -> Nodes:
    """Split all nodes of more than `group_rows` drawn rows, each pass over the table as many
    as have their counts in `memory_mb`."""
    most = max(1, (memory_mb << 18) // (8 * picked * BINS * classes))
    waiting = np.arange(trees)
    while True:
        big = (nodes.counts.sum(axis=1) > group_rows) & nodes.may_split(depth, min_rows)
        waiting = waiting[big[waiting]]
        if not len(waiting):
            return nodes
        now, waiting = waiting[:most], waiting[most:]
        picks = positions_for(nodes.name[now], d, picked)
        place = np.full(len(nodes.name), -1)
        place[now] = np.arange(len(now))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hist = np.zeros((classes, *picks.shape, BINS))
            for x, batch in pieces(batches, trees, d):
                w = draws(number(batch, "hash").astype(np.uint64), trees)
                row, tree = np.nonzero(w)
                at = place[nodes.descend(x, row, tree)]
                here = at >= 0
                row, tree = row[here], tree[here]
                hist += tally(x, row, number(batch, "y"), w[row, tree], at[here], picks, classes)
            hist = hist.transpose(1, 0, 2, 3)
            seen = np.flatnonzero(hist.any(axis=(1, 2, 3)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen), blobs(hist[seen], np.arange(len(seen) + 1))], ["at", "hist"])

        def choose(parts: pa.Table) -> pa.Table:
            at = parts.column("at")[0].as_py()
            hist = sum(np.frombuffer(p.as_py()) for p in parts.column("hist"))
            hist = hist.reshape(classes, 1, picked, BINS)
            position, cut, sides = best_splits(hist, picks[at:at + 1], min_rows)
            return pa.table({"at": [at], "position": position, "cut": cut, "sides": [sides.ravel().tolist()]})

        found = train.mapInArrow(count, "at bigint, hist binary").groupBy("at").applyInArrow(
            choose, "at bigint, position bigint, cut bigint, sides array<double>"
        ).collect()
        found.sort(key=lambda r: r["at"])
        new = nodes.split(
            now[[r["at"] for r in found]], np.array([r["position"] for r in found]),
            np.array([r["cut"] for r in found]), np.array([r["sides"] for r in found]).reshape(-1, 2, classes),
        )
        waiting = np.concatenate([waiting, new])


def forest_votes(
    train: DataFrame, test: DataFrame, classes: int, trees: int, depth: int, seed: int,
    min_rows: int, memory_mb: int, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The test rows' `(key, y, v0, v1, ...)`, sums of the trees' votes, `UNIT` each.

    Both tables: key, y and array x; the training rows' y is the class number. `memory_mb`
    is what a task may take for the counts of the nodes that are split in one pass.
    """
    d = train.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        raise ValueError("no vectors to fit a forest on")
    picked = int(np.ceil(np.sqrt(d)))
    points = split_points(train, d)
    train = durable(binned(train.select(
        F.coalesce(F.col("y").cast("int"), F.lit(-1)).alias("y"), F.xxhash64(F.lit(seed), "key", "x").alias("hash"), "x",
    ), points, "y", "hash", finite=True))
    test = durable(binned(
        test.withColumn("row", F.monotonically_increasing_id()), points, "row", "key", "y", finite=False))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((trees, classes))
        for batch in batches:
            w, y = draws(number(batch, "hash").astype(np.uint64), trees), number(batch, "y")
            if len(y) and not 0 <= y.min() <= y.max() < classes:
                raise ValueError("a training row is of no known class")
            for c in range(classes):
                counts[:, c] += w[y == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(trees), classes)), pa.array(np.tile(np.arange(classes), trees)),
             pa.array(counts.ravel())], ["tree", "class", "n"])

    counts = np.zeros((trees, classes))
    for r in train.mapInArrow(bags, "tree bigint, class bigint, n double").groupBy("tree", "class").agg(
            F.sum("n").alias("n")).collect():
        counts[r["tree"], r["class"]] = r["n"]
    roots = mix(mix(np.array([seed % (1 << 64)], dtype=np.uint64)) ^ np.arange(trees, dtype=np.uint64))
    nodes = upper_nodes(train, Nodes(roots, counts, 0), trees, d, classes, depth, picked, min_rows, group_rows, memory_mb)
    below = (nodes.child < 0) & nodes.may_split(depth, min_rows) & (nodes.counts.sum(axis=1) <= group_rows)
    leaf_votes = nodes.votes()
    outputs = [f"v{c}" for c in range(classes)]

    def by_node(at, x, row, others, is_test: bool) -> pa.RecordBatch:
        """Pairs of rows and nodes, one record per node."""
        order = np.argsort(at, kind="stable")
        node, first = np.unique(at[order], return_index=True)
        bounds = np.append(first, len(at))
        return pa.RecordBatch.from_arrays(
            [pa.array(node), pa.array(np.full(len(node), is_test)), blobs(x[row[order]], bounds),
             *(blobs(o[order], bounds) for o in others)], ["node", "is_test", "x", "a", "b"])

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, batch in pieces(batches, trees, d):
            w = draws(number(batch, "hash").astype(np.uint64), trees)
            row, tree = np.nonzero(w)
            at = nodes.descend(x, row, tree)
            row, tree, at = (v[below[at]] for v in (row, tree, at))
            yield by_node(at, x, row, (number(batch, "y")[row].astype(np.uint8), w[row, tree]), False)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, batch in pieces(batches, trees, d):
            row, tree = (v.ravel() for v in np.indices((len(x), trees)))
            at = nodes.descend(x, row, tree)
            # Votes of upper leaves are known here: all rows in one record, of a node below 0.
            known = np.where(below[at], 0, 1)[:, None] * leaf_votes[at]
            sums, ids = known.reshape(len(x), trees, classes).sum(axis=1), number(batch, "row")
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - int(ids[0])]), pa.array([True]), pa.array([b""]), pa.array([ids.tobytes()]),
                 pa.array([sums.tobytes()])], ["node", "is_test", "x", "a", "b"])
            row, at = (v[below[at]] for v in (row, at))
            yield by_node(at, x, row, (ids[row], np.zeros((len(row), 0), np.uint8)), True)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, tree, votes, told, size = None, [], None, None, [], 0

        def tell() -> pa.RecordBatch:
            row, v = (np.concatenate(part) for part in zip(*told))
            return pa.RecordBatch.from_arrays([pa.array(row), *map(pa.array, v.T.copy())], ["row", *outputs])

        for batch in batches:
            for at, is_test, x, a, b in zip(*(batch.column(c).to_pylist() for c in ("node", "is_test", "x", "a", "b"))):
                if at != node:
                    node, held, tree = at, [], None
                if not is_test:
                    held.append((x, a, b))
                    continue
                row = np.frombuffer(a, np.int64)
                if at < 0:
                    told.append((row, np.frombuffer(b, np.int64).reshape(-1, classes)))
                else:
                    if tree is None:
                        xs, ys, ws = (np.frombuffer(b"".join(h), np.uint8) for h in zip(*held))
                        tree = grow(xs.reshape(-1, d), ys, ws, nodes.name[node], depth, nodes.depth[node],
                                    classes, picked, min_rows)
                        held, votes = [], tree.votes()
                    x, i = np.frombuffer(x, np.uint8).reshape(-1, d), np.arange(len(row))
                    told.append((row, votes[tree.descend(x, i, np.zeros_like(i))]))
                size += len(row)
                if size >= 1 << 16:  # fewer, larger batches
                    yield tell()
                    told, size = [], 0
        if told:
            yield tell()

    schema = "node bigint, is_test boolean, x binary, a binary, b binary"
    rows = train.mapInArrow(hand_out, schema).unionByName(test.mapInArrow(ask, schema))
    # A task of its own for every tree of a small table would be mostly its start.
    few = min(trees, 2 * train.sparkSession.sparkContext.defaultParallelism)
    tasks = max(few, int(below.sum()) // 8, int(counts.sum()) * d >> 25)
    sums = rows.repartition(tasks, "node").sortWithinPartitions("node", "is_test").mapInArrow(
        vote, "row bigint, " + ", ".join(f"{v} bigint" for v in outputs)
    ).groupBy("row").agg(*[F.sum(v).alias(v) for v in outputs])
    return test.select("row", "key", "y").join(sums, "row", "left").drop("row")
