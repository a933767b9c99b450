"""Linear support vector machines, one per class, all fitted in the same passes.

Spark ML's OneVsRest fits its machines one by one, and a machine's loss is evaluated by a job for
each point that its line search tries: some hundred jobs a fit. Here a pass evaluates the points
that the searches of all machines may ask for next. The descent is that of Spark ML's LinearSVC
(Breeze's OWLQN without an L1 part), step by step, so the machines are the same up to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 512  # rows of a block of features
TOLERANCE = 1e-6
MEMORY = 10  # steps that the inverse Hessian is estimated from
TRIED = 20  # points of a line search
GUESSES = 5  # points that a pass evaluates for each machine

Asked = tuple[np.ndarray, np.ndarray]  # values, gradients (a row per point)


def _likely(alpha: float, shrink: float) -> list[float]:
    """Steps that a search may try from `alpha` on, it first, the shorter ways to them before."""
    steps, at = [alpha], 0
    while len(steps) < GUESSES:
        for step in (steps[at] * shrink, steps[at] * 2.1):
            if step not in steps:
                steps.append(step)
        at += 1
    return steps[:GUESSES]


def _direction(grad: np.ndarray, steps: list, deltas: list) -> np.ndarray | None:
    """Less the inverse Hessian times the gradient; None where the history has no such."""
    out, kept = grad.copy(), []
    for s, d in zip(steps, deltas):
        rho = s @ d
        a = (s @ out) / rho
        if np.isnan(a):
            return None
        out -= a * d
        kept.append((rho, a, s, d))
    if steps:
        curve = steps[0] @ deltas[0]
        if not curve >= 0:
            return None
        out *= curve / (deltas[0] @ deltas[0])
    for rho, a, s, d in reversed(kept):
        out += (a - (d @ out) / rho) * s
    return np.where(-out * grad < 0, -out, 0.0)


def descent(size: int, iterations: int) -> Generator[np.ndarray, Asked, np.ndarray]:
    """Yields points (a row each), is sent their values and gradients, returns the last point."""
    x = np.zeros(size)
    values, grads = yield x[None, :]
    value, grad = values[0], grads[0]
    first, recent, iteration, failed, steps, deltas = value, [np.inf], 0, False, [], []
    while iteration < iterations:
        if len(recent) >= 2 and abs(value - max(recent)) <= TOLERANCE * abs(first):
            break
        if np.sqrt(grad @ grad) <= max(TOLERANCE * abs(value), 1e-8):
            break
        way, found = _direction(grad, steps, deltas), None
        if way is not None:
            side = np.where(x != 0, np.sign(x), np.sign(-grad))
            slope, shrink = grad @ way, 0.5 if iteration else 0.1
            alpha = 1.0 if iteration else 0.5 / np.sqrt(grad @ grad)
            seen: dict[float, tuple] = {}
            # The first step counts as tried and too long, wherever a change can be told at all.
            tries, too_long = 0, alpha * slope * 1e-4 + value < value
            while True:
                if not too_long and alpha not in seen:
                    some = [a for a in _likely(alpha, shrink) if a not in seen]
                    points = x + np.array(some)[:, None] * way
                    points = np.where(np.sign(points) == side, points, 0.0)
                    values, grads = yield points
                    seen |= dict(zip(some, zip(points, values, grads)))
                found = seen.get(alpha)
                if too_long or tries and found[1] > value + alpha * slope * 1e-4:
                    factor = shrink
                elif found[2] @ way < 0.9 * slope:
                    factor = 2.1
                elif found[2] @ way > -0.9 * slope:
                    factor = shrink
                else:
                    break
                if not 1e-10 <= alpha * factor <= 1e10:
                    found = None
                    break
                tries, too_long = tries + 1, False
                if tries >= TRIED:
                    break
                alpha *= factor
        if found is None:
            if failed:
                break
            failed, steps, deltas = True, [], []
            continue
        failed = False
        steps, deltas = [found[0] - x, *steps][:MEMORY], [found[2] - grad, *deltas][:MEMORY]
        x, value, grad = found
        recent, iteration = [*recent, value][-20:], iteration + 1
    return x


def _together(searches: list, ask: Callable[[np.ndarray, np.ndarray], Asked]) -> np.ndarray:
    """Run the searches side by side; `ask` takes the points of all and each point's class."""
    ends, wanted = [None] * len(searches), {k: next(s) for k, s in enumerate(searches)}
    while wanted:
        which = np.repeat(list(wanted), [len(p) for p in wanted.values()])
        values, grads = ask(np.concatenate(list(wanted.values())), which)
        for k in list(wanted):
            try:
                wanted[k] = searches[k].send((values[which == k], grads[which == k]))
            except StopIteration as end:
                ends[k] = end.value
                del wanted[k]
    return np.stack(ends)


Blocks = Iterable[tuple[np.ndarray, np.ndarray]]  # features, labels


def _hinge(blocks: Blocks, weights: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """A row per point: summed loss, summed scales, and the scales' sum of features."""
    total = np.zeros((len(weights), 2 + weights.shape[1]))
    for k, label in blocks:
        sign = np.where(label[:, None] == which[None, :], 1.0, -1.0)
        loss = 1.0 - sign * (k @ weights.T + offsets)
        scale = np.where(loss > 0, -sign, 0.0)
        total[:, 0] += np.maximum(loss, 0.0).sum(axis=0)
        total[:, 1] += scale.sum(axis=0)
        total[:, 2:] += scale.T @ k
    return total


def _moments(blocks: Blocks, width: int) -> np.ndarray:
    """Rows, greatest label, means and summed squares about them."""
    n, most, mean, square = 0, -1.0, np.zeros(width), np.zeros(width)
    for k, label in blocks:
        own = k.mean(axis=0)
        gap, rows = own - mean, n + len(k)
        square += ((k - own) ** 2).sum(axis=0) + gap ** 2 * (n * len(k) / rows)
        mean += gap * (len(k) / rows)
        n, most = rows, max(most, label.max())
    return np.concatenate([[n, most], mean, square])


def _joined(parts: list[np.ndarray], width: int) -> np.ndarray:
    whole = np.concatenate([[0.0, -1.0], np.zeros(2 * width)])
    for part in parts:
        if part[0]:
            n, gap = whole[0] + part[0], part[2:2 + width] - whole[2:2 + width]
            whole[2 + width:] += part[2 + width:] + gap ** 2 * (whole[0] * part[0] / n)
            whole[2:2 + width] += gap * (part[0] / n)
            whole[0], whole[1] = n, max(whole[1], part[1])
    return whole


def _fit(
    moments: np.ndarray, width: int, penalty: float, iterations: int,
    sums: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
) -> np.ndarray:
    """A row per class: weights, then the offset. `sums` gives `_hinge` of all rows."""
    n, classes = moments[0], int(moments[1]) + 1
    mean, deviation = moments[2:2 + width], np.sqrt(moments[2 + width:] / max(n - 1, 1))
    inverse = np.divide(1.0, deviation, out=np.zeros(width), where=deviation > 0)
    mean = mean * inverse

    def plain(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return points[:, :-1] * inverse, points[:, -1] - points[:, :-1] @ mean

    def ask(points: np.ndarray, which: np.ndarray) -> Asked:
        total = sums(*plain(points), which)
        ridge = points[:, :-1] * inverse ** 2
        values = total[:, 0] / n + 0.5 * penalty * (points[:, :-1] * ridge).sum(axis=1)
        grads = np.empty_like(points)
        grads[:, :-1] = (total[:, 2:] * inverse - total[:, 1:2] * mean) / n + penalty * ridge
        grads[:, -1] = total[:, 1] / n
        return values, grads

    ends = _together([descent(width + 1, iterations) for _ in range(classes)], ask)
    weights, offsets = plain(ends)
    return np.concatenate([weights, offsets[:, None]], axis=1)


class OneVsRest:
    """Machines over `features`, a function from a matrix of vectors to `width` numbers a row."""

    def __init__(self, features: Callable[[np.ndarray], np.ndarray], width: int, penalty: float, iterations: int):
        self.features, self.width, self.penalty, self.iterations = features, width, penalty, iterations

    def fit(self, rows: DataFrame) -> Machines:
        """`rows`: label, a class number, and array x. A task's blocks are kept by Spark between the
        passes; the rows of a single task are fitted within it, without a job per pass."""
        features, width, penalty, iterations = self.features, self.width, self.penalty, self.iterations

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label = batch.column("label").to_numpy(zero_copy_only=False)
                if not (label >= 0).all():
                    raise ValueError("a training row is of no known class")
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
                for at in range(0, len(label), BLOCK):
                    k = features(x[at:at + BLOCK])
                    if not np.isfinite(k).all():
                        raise ValueError("vectors must be finite for a fit")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label[at:at + BLOCK].tobytes()]), pa.array([k.tobytes()])], ["label", "k"])

        def each(run: Callable[[Blocks], np.ndarray]) -> list[np.ndarray]:
            """What `run` gives for the rows of each task, in the order of the tasks."""
            return blocks.mapPartitions(lambda some: [run(
                (np.frombuffer(k).reshape(-1, width), np.frombuffer(label)) for label, k in some)]).collect()

        def whole(some: Blocks) -> np.ndarray:
            held = list(some)
            return _fit(_moments(held, width), width, penalty, iterations, lambda *a: _hinge(held, *a))

        # Of all that Spark keeps, blocks of an RDD are the fastest to hand to Python again and again.
        blocks = rows.select("label", "x").mapInArrow(pack, "label binary, k binary").rdd.map(tuple)
        if blocks.getNumPartitions() == 1:
            (weights,) = each(whole)
        else:
            blocks.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                moments = _joined(each(lambda some: _moments(some, width)), width)
                weights = _fit(moments, width, penalty, iterations, lambda *points: sum(
                    each(lambda some: _hinge(some, *points))))
            finally:
                blocks.unpersist()
        return Machines(features, weights)


class Machines:
    def __init__(self, features: Callable[[np.ndarray], np.ndarray], weights: np.ndarray):
        self.features, self.weights = features, weights

    def margins(self, x: Column | str) -> Column:
        """One margin per class of an array."""
        features, weights = self.features, self.weights

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            out: list[np.ndarray] = []
            for at in range(0, len(x), BLOCK):
                k = features(np.stack(x.iloc[at:at + BLOCK].to_numpy()))
                out.extend(k @ weights[:, :-1].T + weights[:, -1])
            return pd.Series(out, dtype=object)

        return run(x)
