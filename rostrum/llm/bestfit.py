"""Best-fit packing of whole documents after a dominance reduction.

What is to be packed is known by how many pieces there are of each length: a table that does
not grow with the corpus. On it, sets of one to three lengths that dominate every other way
to use their largest member are fixed for good, as often as they can be formed; what is left is
packed best-fit, longest first. Both run on counts, so the plan is a bounded list of kinds of
sequences, and every piece finds its place from its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from rostrum.llm.word_ids import word_end_ids
from rostrum.session import durable

CAPACITY = 2048
END = 0
BATCH = 64

PIECES = ("doc bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, "
          "nth bigint, ids array<int>")
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(),
         pa.list_(pa.int32())]


def pieces(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and one end id, cut only beyond the capacity.

    A null or empty text is the end id alone; a row without an id keeps a null id; rows that
    repeat are packed once each. `nth` numbers a task's pieces of one length. `with_ids`
    adds the ids themselves; else that column is null. Other columns are left out.
    """
    names = [part.split()[0] for part in PIECES.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = word_end_ids(vocabulary), TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch, rows = whole.slice(at, BATCH), []
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                    ids += END.to_bytes(4, "little")
                    for i, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start:4 * (start + capacity)]
                        n = len(own) // 4
                        rows.append((doc, i, start, n, zlib.crc32(own), task, seen[n],
                                     np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*rows), KINDS)], names
                )

    return docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")
    ).mapInArrow(make, PIECES)


class Lengths:
    """How many pieces there are of each length, from 1 to the capacity."""

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            self.left[n] = c

    def lightest(self, k: int, above: int = 0) -> list[int]:
        """The k shortest pieces longer than `above`, as far as there are any."""
        out: list[int] = []
        for n in np.flatnonzero(self.left[above + 1:above + 1 + self.capacity]) + above + 1:
            out += [int(n)] * min(k - len(out), int(self.left[n]))
            if len(out) == k:
                break
        return out

    def longest_within(self, room: int) -> int:
        """The longest piece that fits; 0 if none does."""
        there = np.flatnonzero(self.left[:room + 1])
        return int(there[-1]) if len(there) else 0

    def longest_pair(self, room: int) -> tuple[int, int]:
        """Two pieces a >= b of the largest sum that fits; a as long as it can be."""
        there = np.flatnonzero(self.left[:room + 1])
        at = np.searchsorted(there, np.minimum(room - there, there), side="right") - 1
        partner = np.where(at >= 0, there[np.maximum(at, 0)], 0)
        # A piece cannot be its own partner unless there are two of its length.
        alone = (partner == there) & (self.left[there] < 2)
        partner[alone] = np.where(at[alone] > 0, there[np.maximum(at[alone] - 1, 0)], 0)
        total = np.where(partner > 0, there + partner, 0)
        if not len(total) or not total.max():
            return 0, 0
        best = len(total) - 1 - int(np.argmax(total[::-1]))
        return int(there[best]), int(partner[best])


def dominating(lengths: Lengths, j: int) -> tuple[int, ...] | None:
    """Companions of a piece of length j that no other choice of companions beats, or None.

    A set dominates another one when its members can stand in for those of the other. The
    piece itself is not among `lengths`.
    """
    room = lengths.capacity - j
    light = lengths.lightest(3)
    if not light or light[0] > room:
        return ()
    one = lengths.longest_within(room)
    if one == room or len(light) < 2 or light[0] + light[1] > room:
        return (one,)
    if len(light) == 3 and sum(light) <= room:
        return None
    # At most two companions. All pairs that fit are no better than the longest single one,
    # or than the longest pair if no pair has a shorter member above the pair's.
    a, b = lengths.longest_pair(room)
    if one >= a + b:
        return (one,)
    if a == one:
        above = lengths.lightest(2, above=b)
        if len(above) < 2 or sum(above) > room:
            return (a, b)
    return None


def reduce_by_dominance(lengths: Lengths) -> list[tuple[tuple[int, ...], int]]:
    """Take every dominating set out of `lengths`: the sets, and how often each is formed.

    A set stays dominating while its members last, because what else is left only gets
    fewer and its shortest members longer; so it is formed as often as it can be at once.
    """
    fixed, again = [], True
    while again:
        again = False
        for j in np.flatnonzero(lengths.left)[::-1].tolist():
            while lengths.left[j]:
                lengths.left[j] -= 1
                found = dominating(lengths, j)
                lengths.left[j] += 1
                if found is None:
                    break
                own = Counter((j, *found))
                times = min(int(lengths.left[n]) // c for n, c in own.items())
                for n, c in own.items():
                    lengths.left[n] -= c * times
                fixed.append(((j, *found), times))
                again = True
    return fixed


def best_fit(lengths: Lengths) -> list[tuple[tuple[int, ...], int]]:
    """Pack what is left, longest first, each into the fullest sequence that takes it."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def keep(members: tuple[int, ...], times: int) -> None:
        if times:
            open_.setdefault(lengths.capacity - sum(members), []).append((members, times))

    for n in np.flatnonzero(lengths.left)[::-1].tolist():
        left, done = int(lengths.left[n]), []
        for room in sorted(r for r in open_ if r >= n):
            while left and open_[room]:
                members, times = open_[room].pop()
                each = room // n  # the sequence stays the fullest one until it is full
                full = min(times, left // each)
                left -= full * each
                done.append((members + (n,) * each, full))
                if full < times and left:
                    done.append((members + (n,) * left, 1))
                    full, left = full + 1, 0
                if full < times:
                    done.append((members, times - full))
        each = lengths.capacity // n
        done += [((n,) * each, left // each), ((n,) * (left % each), 1 if left % each else 0)]
        for members, times in done:
            keep(members, times)
        lengths.left[n] = 0
    return [kind for kinds in open_.values() for kind in kinds]


SEGMENTS = ("length bigint, first bigint, last bigint, share bigint, sequence bigint, "
            "place bigint")


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Where the pieces of each length go, by their numbers, and how many sequences there are.

    A row says: pieces `first` to `last` of this length go `share` to a sequence, from
    `sequence` on, beginning at `place`. There are at most eight kinds of sequences per length of
    the capacity, each of 63 different lengths at most (1 + 2 + ... + 64 > 2048), whatever
    the corpus holds.
    """
    lengths = Lengths(counts, capacity)
    kinds = reduce_by_dominance(lengths) + best_fit(lengths)
    used, rows, sequence = Counter(), [], 0
    for members, times in kinds:
        place = 0
        for n, share in Counter(members).items():
            rows.append((n, used[n], used[n] + share * times - 1, share, sequence, place))
            used[n] += share * times
            place += n * share
        sequence += times
    return rows, sequence


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to `pieces`: where each piece lies. Empty in, empty out.

    A piece's number is its number within its task plus the counts of the tasks before, so
    nothing is sorted, and pieces of one length, however many, stay spread over the tasks.
    """
    parts = durable(parts, "pieces")
    spark = parts.sparkSession
    shares = durable(parts.groupBy("length", "task").agg(F.count("*").alias("n")), "shares")
    counts = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = shares.select(
        "length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")
    )
    number = F.col("_base") + F.col("nth")
    segments = spark.createDataFrame(rows, SEGMENTS).withColumnRenamed("length", "_length")
    inside = number - F.col("first")
    return parts.join(bases, ["length", "task"]).join(
        F.broadcast(segments),  # see `plan` for its bound
        (F.col("length") == F.col("_length")) & number.between(F.col("first"), F.col("last")),
    ).select(
        "doc", "piece", "start", "length", "ids_crc32", "ids",
        (F.col("sequence") + F.floor(inside / F.col("share"))).alias("sequence_id"),
        (F.col("place") + F.pmod(inside, F.col("share")) * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """`(sequence_id, tokens, used)`: the sequences of `pack` over pieces with ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # of one sequence
    joined = packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(inside, lambda x: x["ids"])).alias("tokens")
    )
    return joined.withColumn("used", F.size("tokens"))
