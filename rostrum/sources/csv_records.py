"""CSV records with quoted line breaks, read in parallel from files of any size.

A file is split at line ends as any text is, without regard to quotes. Whether a split begins
inside a quoted field is known once each split has told what it makes of either case: outside
or inside at its beginning, where does it end? A first pass asks that of the lines that hold
quotes; the answers, one small row per split, are chained in file order; a second pass joins
lines to records. Records cut by a split's end are put together from their pieces.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.session import durable

# Splits whose beginnings are sent to every task; 128 TB in splits of 128 MB.
MOST_SENT = 1 << 20
OUTSIDE, INSIDE = 0, 1

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"[^,]*+'
_FIELD = rf'(?:{_QUOTED}|(?!")[^,]*+)'
_FIELDS = re.compile(rf"(?:{_FIELD},)*+")
_LAST = re.compile(rf"{_FIELD}$")
_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"[^,]*+')


def state_after(line: str, state: int) -> int:
    """Whether a line that begins outside or inside a quoted field ends inside one.

    A quote opens a field only at its beginning; after the closing quote the field goes on
    to the next comma.
    """
    if '"' not in line:
        return state
    at = 0
    if state == INSIDE:
        closing = _CLOSING.match(line)
        if closing is None:
            return INSIDE
        at = closing.end()
        if at == len(line):
            return OUTSIDE
        at += 1  # the comma
    at = _FIELDS.match(line, at).end()
    return OUTSIDE if _LAST.match(line, at) else INSIDE


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value",
    )


ENDS = "file bigint, at bigint, from_outside int, from_inside int, header string"
STARTS = "file bigint, at bigint, state int, header string"
PIECES = "file bigint, at bigint, kind int, record string"
WHOLE, HEAD, TAIL = 0, 1, 2


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    fields = [part.split() for part in schema.split(", ")]
    cells = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[k]) for c, (_, k) in zip(cells, fields)], [n for n, _ in fields]
    )


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The batch cut where the split changes; its first columns are file and at."""
    file, at = (batch.column(i).to_numpy() for i in (0, 1))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (at[1:] != at[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield (int(file[a]), int(at[a])), batch.slice(a, b - a)


class _Split:
    """What a split's lines tell of its end, and a file's first record."""

    def __init__(self, place: tuple[int, int]):
        self.place, self.ends, self.header, self.state = place, [OUTSIDE, INSIDE], [], OUTSIDE

    def add(self, line: str) -> None:
        if self.place[1] == 0 and (not self.header or self.state == INSIDE):
            self.header.append(line)
            self.state = state_after(line, self.state)
        if '"' in line:
            self.ends = [state_after(line, s) for s in self.ends]

    def row(self) -> tuple:
        return *self.place, *self.ends, "\n".join(self.header) if self.header else None


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, []
    for batch in batches:
        for place, part in _by_split(batch):
            if now is None or place != now.place:
                out += [now.row()] if now else []
                now = _Split(place)
            lines = part.column(2)
            if place[1]:
                lines = lines.filter(pc.not_equal(lines, ""))
            for line in lines.to_pylist():
                now.add(line)
    yield _rows(out + ([now.row()] if now else []), ENDS)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits by (file, place): the state each begins in."""
    now, state = None, OUTSIDE
    for batch in batches:
        out = []
        for file, at, *ends, header in zip(*(c.to_pylist() for c in batch.columns)):
            if file != now:
                now, state = file, OUTSIDE
            out.append((file, at, state, header))
            state = ends[state]
        yield _rows(out, STARTS)


def starts(lines: DataFrame) -> DataFrame:
    """`(file, at, state, header)` of every split that has lines; the header is a file's first
    record, told by its first split."""
    # Lines without quotes end as they begin; of those only a file's first counts.
    told = F.when(F.contains("value", F.lit('"')) | (F.col("at") == 0), F.col("value")).otherwise("")
    found = lines.select("file", "at", told.alias("value")).mapInArrow(_ends, ENDS)
    return found.repartition("file").sortWithinPartitions("file", "at").mapInArrow(_chain, STARTS)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order to whole records; what a split begins or ends within stays a piece. A
    file's first record is its header and goes."""
    now, state, open_, kind, header = None, OUTSIDE, [], WHOLE, False

    def last() -> list[tuple]:
        return [(*now, TAIL if kind == WHOLE else kind, "\n".join(open_))] if open_ else []

    for batch in batches:
        out = []
        for place, part in _by_split(batch):
            if place != now:
                out += last()
                now, state, open_ = place, part.column(3)[0].as_py(), []
                kind, header = HEAD if state == INSIDE else WHOLE, place[1] == 0
            for line in part.column(2).to_pylist():
                open_.append(line)
                if '"' in line:
                    state = state_after(line, state)
                if state == OUTSIDE:
                    if not header:
                        out.append((*now, kind, "\n".join(open_)))
                    open_, kind, header = [], WHOLE, False
        yield _rows(out, PIECES)
    yield _rows(last(), PIECES)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by (file, place, kind): a tail and the heads up to the next tail are a record."""
    now, open_ = None, []
    for batch in batches:
        out = []
        for file, _, kind, record in zip(*(c.to_pylist() for c in batch.columns)):
            if open_ and (kind == TAIL or file != now):
                out.append((now, 0, WHOLE, "\n".join(open_)))
                open_ = []
            now = file
            open_.append(record)
        yield _rows(out, PIECES)
    if open_:
        yield _rows([(now, 0, WHOLE, "\n".join(open_))], PIECES)


def records(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """`(file, record)`: the text of every record but the headers and empty lines; and
    `(file, header)`. Records end with a line feed, alone or behind a carriage return. A
    header has to lie within its file's first split."""
    lines = _lines(spark, path)
    begun = durable(starts(lines), "splits")
    if begun.count() <= MOST_SENT:
        dealt = lines.join(F.broadcast(begun.drop("header")), ["file", "at"])  # lines keep their order
    else:
        dealt = lines.select("*", F.monotonically_increasing_id().alias("line")).join(
            begun.drop("header"), ["file", "at"]
        ).repartition("file", "at").sortWithinPartitions("file", "at", "line")
    # Read for the whole records and for the cut ones.
    found = durable(dealt.select("file", "at", "value", "state").mapInArrow(_pieces, PIECES), "records")
    cut = found.where(F.col("kind") != WHOLE).repartition("file").sortWithinPartitions(
        "file", "at", "kind"
    ).mapInArrow(_joined, PIECES)
    every = found.where(F.col("kind") == WHOLE).unionByName(cut)
    ended = F.endswith("record", F.lit("\r"))
    bare = F.when(ended, F.expr("left(record, char_length(record) - 1)")).otherwise(F.col("record"))
    return (every.select("file", bare.alias("record")).where(F.col("record") != ""),
            begun.where(F.col("header").isNotNull()).select("file", "header"))


def header_names(header: str) -> list[str]:
    return next(csv.reader([header.lstrip("\ufeff").rstrip("\r")]), [])


def fields_by_name(spark: SparkSession, path: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """The named columns of CSV files as text, each file by its own header.

    Quoted fields may hold line breaks, commas and doubled quotes. Fields missing at a record's
    end are NULL. A file without one of the columns stops the query.
    """
    @F.udf("struct<width: int, places: array<int>>")
    def places(header):  # called once per file
        own = header_names(header)
        return len(own), [own.index(n) if n in own else -1 for n in names]

    rows, headers = records(spark, path)
    headers = durable(headers.select("file", places("header").alias("p")).select("file", "p.*"), "headers")
    width, lacking, files = headers.agg(
        F.max("width"), F.max(F.exists("places", lambda x: x < 0)), F.count("*")
    ).first()
    if lacking:
        raise ValueError(f"a file of {path} lacks one of {list(names)}")
    if not files:
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    schema = ", ".join(f"c{i} string" for i in range(width))
    # Every record is parsed by itself: the reader's usual buffer of a million letters would be
    # made anew each time.
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "inputBufferSize": "16384"}
    parsed = F.from_csv("record", schema, options)
    known = F.broadcast(headers) if files <= MOST_SENT else headers
    # As a generator, so that a record is parsed once and not once per column.
    cells = rows.join(known, "file").select("places", F.inline(F.array(parsed))).select(
        F.array(*[F.col(f"c{i}") for i in range(width)]).alias("cells"), "places"
    )
    return cells.select(*[
        F.get("cells", F.get("places", F.lit(i))).alias(n) for i, n in enumerate(names)
    ])
