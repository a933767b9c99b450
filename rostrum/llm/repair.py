"""Repair of conversations: faults, the cheapest edits, and the repaired turns.

Rows of one conversation that agree in turn, role and text fold to one row with a count. The
folded rows - hashes, not texts - are dealt out by range of (conversation, turn, role, hash), so a
conversation of any size is cut into stretches that lie in different tasks. A stretch
becomes runs of equal symbols. Conversations inside one task are settled there; the at most two
that a task shares with its neighbours give one small cost matrix each, the matrices are chained
backwards and the states forwards, and the stretches then choose their edits apart from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from rostrum.llm import minplus
from rostrum.session import durable

BLANK = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
ORDER = ["turn", "role", "h1", "h2"]  # nulls first


def damaged(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """`(conv, turn, role, text, copies)`: rows damaged by a hash of their place. A dropped row
    stays with no copies, so that its conversation is still known; a null counts as one space."""
    key = F.concat_ws(":", *[
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conversation, turn)
    ])
    rows = df.select(
        F.col(f"`{conversation}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    )
    kind = F.col("kind")
    return rows.select(
        "conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def hashes() -> list[Column]:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def symbols(rows: DataFrame) -> DataFrame:
    """`(conv, turn, role, h1, h2, sym, n, more)`: folded rows. `sym` is that of the first copy;
    `more` that of the n - 1 others."""
    cut = F.btrim("text", F.lit(BLANK))
    fault = F.when(cut == "", minplus.BLANK).when(
        ~F.substring(cut, -1, 1).isin(*ENDS), minplus.TRUNCATED_FAULT).otherwise(minplus.SOUND)
    folded = rows.where(F.col("copies") > 0).select(
        "conv", "turn", "role", *hashes(), fault.alias("fault"), "copies"
    ).groupBy("conv", "turn", "role", "h1", "h2", "fault").agg(F.sum("copies").alias("n"))
    # Where a text stands first in its conversation; the struct keeps null turns first.
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    firsts = folded.groupBy("conv", "role", "h1", "h2").agg(F.min(place).alias("first"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv", "role", "h1", "h2")]
    both = folded.alias("a").join(firsts.alias("b"), same).select("a.*", "b.first")
    initial = F.instr(F.lit(minplus.INITIALS), F.substring("role", 1, 1))
    # `instr` finds an empty role at place 1.
    at = F.when((initial > 0) & (F.col("role") != ""), initial - 1).otherwise(3)
    repeated = F.when(F.col("fault") == minplus.BLANK, minplus.BLANK).otherwise(minplus.DUPLICATE)
    return both.select(
        "conv", *ORDER, (F.when(place > F.col("first"), repeated).otherwise(F.col("fault")) * 4 + at).alias("sym"),
        "n", (repeated * 4 + at).alias("more"),
    )


FOUND = ("conv bigint, slice int, whole boolean, audit string, cost bigint, symbols array<int>, "
         "counts array<bigint>, matrix array<bigint>, end int")


class _Runs:
    """Consecutive equal symbols of one conversation."""

    def __init__(self, conv: int | None):
        self.conv, self.symbols, self.counts = conv, [], []

    def add(self, sym: int, n: int) -> None:
        if n and self.symbols and self.symbols[-1] == sym:
            self.counts[-1] += n
        elif n:
            self.symbols.append(sym)
            self.counts.append(n)

    def settled(self, slice_: int) -> tuple:
        audit, cost, _ = minplus.unroll(self.symbols, self.counts, minplus.AT_END, minplus.NOTHING, True)
        return self.conv, slice_, True, audit, cost, self.symbols, self.counts, None, None

    def open(self, slice_: int) -> tuple:
        matrix = [c for line in minplus.stretch(self.symbols, self.counts) for c in line]
        return self.conv, slice_, False, None, None, self.symbols, self.counts, matrix, None


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
             "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
             "array<string>": pa.list_(pa.string())}
    fields = [part.split() for part in schema.split(", ")]
    cells = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[k]) for c, (_, k) in zip(cells, fields)], [n for n, _ in fields]
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted folded rows to runs. The first and the last conversation of a task may go on in
    another one, so they stay open."""
    slice_, now, first = TaskContext.get().partitionId(), None, True
    for batch in batches:
        out = []
        for conv, sym, n, more in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.open(slice_) if first else now.settled(slice_))
                    first = False
                now = _Runs(conv)
            now.add(sym, 1)
            now.add(more, n - 1)
        if out:
            yield _batch(out, FOUND)
    if now is not None:
        yield _batch([now.open(slice_)], FOUND)


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open stretches by (conversation, falling slice): costs to the end from behind each."""
    conv, after, begun = None, minplus.AT_END, False
    for batch in batches:
        out = []
        for c, slice_, flat in zip(*(batch.column(i).to_pylist() for i in range(3))):
            last = not begun or c != conv
            if last:
                conv, after, begun = c, minplus.to_end(True, minplus.AT_END), True
            out.append((c, slice_, last, list(after)))
            after = minplus.apply([flat[4 * i:4 * i + 4] for i in minplus.STATES], after)
        yield _batch(out, "conv bigint, slice int, last boolean, after array<bigint>")


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stretch's edits from each of the four states it may begin in."""
    for batch in batches:
        for conv, slice_, syms, counts, last, after in zip(*(batch.column(i).to_pylist() for i in range(6))):
            # From a state without a way to the end no conversation comes.
            ways = [minplus.unroll(syms, counts, tuple(after), s, last) for s in minplus.STATES]
            audits, costs, ends = map(list, zip(*ways))
            yield _batch([(conv, slice_, audits, costs, ends)], WAYS)


WAYS = "conv bigint, slice int, audits array<string>, costs array<bigint>, ends array<int>"


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches by (conversation, slice): the state each begins in."""
    conv, state, begun = None, minplus.NOTHING, False
    for batch in batches:
        out = []
        for c, slice_, ends in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not begun or c != conv:
                conv, state, begun = c, minplus.NOTHING, True
            out.append((c, slice_, state))
            state = ends[state]
        yield _batch(out, "conv bigint, slice int, start int")


def edits(folded: DataFrame) -> DataFrame:
    """`(conv, slice, audit, cost, symbols, counts)`: the cheapest edits of every stretch of
    `symbols`; the stretches of a conversation in the order of their slices."""
    folded = durable(folded, "folded")  # read for the ranges and for the rows
    dealt = folded.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    found = durable(dealt.select("conv", "sym", "n", "more").mapInArrow(_stream, FOUND), "stretches")
    columns = ["conv", "slice", "audit", "cost", "symbols", "counts"]
    # Two rows per task of the pass above at most.
    open_ = found.where(~F.col("whole"))
    after = open_.select("conv", "slice", "matrix").repartition("conv").sortWithinPartitions(
        "conv", F.desc("slice")
    ).mapInArrow(_backwards, "conv bigint, slice int, last boolean, after array<bigint>")
    ways = durable(_same(open_, after, "conv", "slice").select(
        "a.conv", "a.slice", "symbols", "counts", "last", "after"
    ).mapInArrow(_unrolled, WAYS), "ways")
    starts = ways.select("conv", "slice", "ends").repartition("conv").sortWithinPartitions(
        "conv", "slice"
    ).mapInArrow(_forwards, "conv bigint, slice int, start int")
    chosen = _same(ways, starts, "conv", "slice").select(
        "a.conv", "a.slice", F.get("audits", F.col("start")).alias("audit"),
        F.get("costs", F.col("start")).alias("cost"),
    )
    settled = _same(open_.drop("audit", "cost"), chosen, "conv", "slice").select(
        "a.conv", "a.slice", "audit", "cost", "symbols", "counts"
    )
    return found.where("whole").select(*columns).unionByName(settled.select(*columns))


def _same(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])


class _Repair:
    """A conversation's rows against its edits, one at a time."""

    def __init__(self, conv: int | None):
        self.conv, self.audit, self.cost, self.faults = conv, [], 0, [0] * 4
        self.edits, self.at, self.state = "", 0, minplus.NOTHING
        self.turns, self.span, self.illegal, self.last_initial = 0, None, 0, None
        self.hash, self.written = hashlib.sha256(), 0

    def told(self, audit: str, cost: int, symbols: list[int], counts: list[int]) -> None:
        self.audit.append(audit)
        self.cost += cost
        for sym, n in zip(symbols, counts):
            self.faults[minplus.fault_of(sym)] += n

    def write(self, role: str, text: str) -> tuple[str, str]:
        line = f"{role}:{text}"
        self.hash.update(("\n" * bool(self.written) + line).encode("utf-8", "surrogatepass"))
        self.written += 1
        return role, text

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            yield self.write(minplus.ROLES[self.state], "")
            self.state = minplus.NEXT[self.state]
            self.at += 1

    def row(self, turn: int | None, role: str, text: str, copies: int) -> Iterator[tuple[str, str]]:
        if turn is not None and copies:
            if self.span is None:
                self.span, self.turns = [turn, turn], 1
            elif turn != self.span[1]:
                self.span[1], self.turns = turn, self.turns + 1
        for _ in range(copies):
            if self.last_initial is not None and self.last_initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.last_initial = role[:1]
            yield from self.inserted()
            edit = self.edits[self.at]
            self.at += 1
            if edit == "K":
                yield self.write(role, text)
                self.state = minplus.KEPT[role[:1]][self.state]
            elif edit == "R":
                yield self.write(minplus.ROLES[self.state], text)
                self.state = minplus.NEXT[self.state]

    def summary(self) -> tuple:
        gaps = self.span[1] - self.span[0] + 1 - self.turns if self.span else 0
        return (self.conv, gaps, self.faults[minplus.BLANK], self.faults[minplus.DUPLICATE],
                self.faults[minplus.TRUNCATED_FAULT], self.illegal, self.cost, self.edits,
                self.hash.hexdigest())


SUMMARY = ("conv bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
           "cost bigint, audit string, repaired_sha256 string")
TURNS = "conv bigint, place bigint, role string, text string"
BATCH_ROWS = 4096


def _carry_out(rows: DataFrame, chosen: DataFrame, turns: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repair | None = None
        out: list[tuple] = []

        def written(found: Iterator[tuple[str, str]]) -> None:
            for place, (role, text) in enumerate(found, now.written):
                if turns:
                    out.append((now.conv, place, role, text))

        def finish() -> None:
            now.edits = now.edits or "".join(now.audit)
            written(now.inserted())
            if not turns:
                out.append(now.summary())

        for batch in batches:
            for conv, audit, cost, syms, counts, turn, role, text, copies in zip(
                    *(batch.column(i).to_pylist() for i in range(9))):
                if now is None or conv != now.conv:
                    if now is not None:
                        finish()
                    now = _Repair(conv)
                if audit is not None:
                    now.told(audit, cost, syms, counts)
                    continue
                now.edits = now.edits or "".join(now.audit)
                written(now.row(turn, role, text, copies))
                if len(out) >= BATCH_ROWS:
                    yield _batch(out, TURNS if turns else SUMMARY)
                    out = []
        if now is not None:
            finish()
        if out:
            yield _batch(out, TURNS if turns else SUMMARY)

    none = lambda kind: F.lit(None).cast(kind)
    told = chosen.select(
        "conv", F.lit(0).alias("kind"), "slice", "audit", "cost", "symbols", "counts",
        none("bigint").alias("turn"), none("string").alias("role"), none("bigint").alias("h1"),
        none("bigint").alias("h2"), none("string").alias("text"), none("bigint").alias("copies"),
    )
    own = rows.select(
        "conv", F.lit(1).alias("kind"), F.lit(0).alias("slice"), none("string").alias("audit"),
        none("bigint").alias("cost"), none("array<int>").alias("symbols"), none("array<bigint>").alias("counts"),
        "turn", "role", *hashes(), "text", "copies",
    )
    return told.unionByName(own).repartition("conv").sortWithinPartitions(
        "conv", "kind", "slice", *ORDER
    ).select(
        "conv", "audit", "cost", "symbols", "counts", "turn", "role", "text", "copies"
    ).mapInArrow(run, TURNS if turns else SUMMARY)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows` (conv, turn, role, text, copies): gaps, faults, the
    cheapest edits and a digest of the repaired turns.

    Rows are taken by turn (nulls first), then role and hash of the text. Rows without an id
    are one conversation. A role that is empty or begins with none of s, u and a cannot be
    kept. A conversation without rows, or whose rows have no copies, has zeros, no edits and
    the digest of nothing. The digest and the edits of a conversation are one cell each that
    depends on all its rows, so its rows pass through one task - as a stream that holds a batch
    and the edits, one letter per row. Counting faults and choosing edits are spread.
    """
    return _carry_out(rows, edits(symbols(rows)), False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """`(conv, place, role, text)`: the turns of the repaired conversations."""
    return _carry_out(rows, edits(symbols(rows)), True)
