"""Lines that other documents hold already: keep bitmaps instead of text.

Hashes of line keys are dealt out by range of (hash, document, position) and sorted
so; each task streams its rows and sees the first document of every hash. A very
frequent line spreads over many ranges. Only the run that opens a range can have
begun before it; those runs are settled through the ranges' edges, one or two rows
per task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType

from rostrum.llm.registry import fresh
from rostrum.session import durable

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 10
LAST_ID = (1 << 63) - 1

FOUND = "kind int, h1 bigint, h2 bigint, doc bigint, version bigint, pos int"
DROP, OPEN, EDGE = 0, 1, 2


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _doc(id_column: str) -> Column:
    """A row without an id counts as the largest id."""
    return F.coalesce(F.col(f"`{id_column}`").cast("bigint"), F.lit(LAST_ID))


def _text(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
          least: int = LEAST_CHARS) -> DataFrame:
    """`(h1, h2, doc, version, pos)` of every line whose key is long enough. `version`
    tells apart different texts under one id; equal rows share their decisions."""
    split = docs.select(
        _doc(id_column).alias("doc"), F.xxhash64(_text(text)).alias("version"),
        F.posexplode(F.split(_text(text), "\n")).alias("pos", "line"),
    ).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least)
    return split.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
        "doc", "version", "pos",
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2, doc, ...): drop what is not of the run's first document;
    the run that opens the task stays open, and its edge and the last run's are told."""
    opening = last = None  # hash of the first run; (hash, first document) of the current one
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2, doc = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None:
            new[0] = (h1[0], h2[0]) != last[0]
        else:
            opening = (h1[0], h2[0])
            yield _edges([(opening, doc[0])])
        starts = np.flatnonzero(new)
        first = np.empty(n, np.int64)
        run = np.cumsum(new) - 1
        if len(starts):
            first[:] = doc[starts[np.maximum(run, 0)]]
        if run[0] < 0 or not new[0]:
            first[run < 0] = last[1]
        is_open = (h1 == opening[0]) & (h2 == opening[1])
        drop = ~is_open & (doc != first)
        out = np.flatnonzero(is_open | drop)
        if len(out):
            taken = batch.take(pa.array(out))
            kind = pa.array(np.where(is_open[out], OPEN, DROP).astype(np.int32))
            yield pa.RecordBatch.from_arrays([kind, *taken.columns], ["kind", *batch.schema.names])
        last = ((h1[-1], h2[-1]), first[-1])
    if last is not None:
        yield _edges([last])


def _edges(rows) -> pa.RecordBatch:
    cells = [(EDGE, int(h[0]), int(h[1]), int(doc), 0, -1) for h, doc in rows]
    names = ["kind", "h1", "h2", "doc", "version", "pos"]
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*cells), kinds)], names
    )


def dropped_lines(rows: DataFrame) -> DataFrame:
    """`(doc, version, pos)` of the lines that an earlier document holds. `rows`: `lines`."""
    order = ["h1", "h2", "doc", "version", "pos"]
    found = durable(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, FOUND),
        "lines",
    )
    first = found.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    still_open = found.where(F.col("kind") == OPEN).join(
        F.broadcast(first), ["h1", "h2"]  # two rows per task of the pass above at most
    ).where(F.col("doc") != F.col("first"))
    return found.where(F.col("kind") == DROP).select("doc", "version", "pos").unionAll(
        still_open.select("doc", "version", "pos")
    )


@F.pandas_udf(BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    """Compressed bits, one per line, 1 for lines that stay."""
    def pack(n, gone):
        keep = np.ones(-(-n // 8) * 8, np.uint8)  # whole bytes: bits beyond the lines are 1
        keep[np.asarray(gone, np.int64)] = 0
        return zlib.compress(np.packbits(keep).tobytes())
    return pd.Series([pack(n, d) for n, d in zip(n_lines, dropped)], dtype=object)


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                 least: int = LEAST_CHARS) -> DataFrame:
    """`(doc, version, n_dropped, bitmap)` of the documents that lose lines; all others
    keep every line. A bitmap has a bit per line of its document, zlib-compressed."""
    gone = dropped_lines(lines(docs, id_column, text, least))
    per_doc = gone.distinct().groupBy("doc", "version").agg(
        F.collect_list("pos").alias("gone"), F.max("pos").alias("most"),
    )
    return per_doc.select(
        "doc", "version", F.size("gone").cast("bigint").alias("n_dropped"),
        # Lines after the last dropped one stay; a missing bit reads as 1.
        _bitmap(F.col("most") + 1, "gone").alias("bitmap"),
    )


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
        keep[:len(bits)] = bits.astype(bool)
    return keep


@F.pandas_udf(StringType())
def kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def cut(t, b):
        if b is None:
            return t
        parts = t.split("\n")
        keep = unpack(b, len(parts))
        return "\n".join(p for p, k in zip(parts, keep) if k)
    return pd.Series([cut(t, b) for t, b in zip(text, bitmap)], dtype=object)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                least: int = LEAST_CHARS) -> DataFrame:
    """`docs` with `text` without the lines that a smaller document holds, plus
    `n_lines` (before) and `n_dropped`.

    Null and empty texts are one empty line and come back as ''. Rows without an id
    count as one document with the largest id. Rows that share id and text share
    their decisions; lines repeated within their first document all stay. Other
    columns pass through; new ones get underscores if their names are taken.
    """
    before, gone, doc, version, bitmap, lost = fresh(
        docs, "n_lines", "n_dropped", "doc_", "version_", "bitmap_", "lost_"
    )
    maps = keep_bitmaps(docs, id_column, text, least).select(
        F.col("doc").alias(doc), F.col("version").alias(version),
        F.col("bitmap").alias(bitmap), F.col("n_dropped").alias(lost),
    )
    own = docs.withColumns({doc: _doc(id_column), version: F.xxhash64(_text(text))})
    joined = own.join(maps, [doc, version], "left")
    return joined.withColumns({
        text: kept_text(_text(text), F.col(bitmap)),
        before: F.size(F.split(_text(text), "\n")).cast("bigint"),
        gone: F.coalesce(F.col(lost), F.lit(0)),
    }).select(*docs.columns, before, gone)
