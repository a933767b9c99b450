"""Harmonic packing of token sequences of a fixed capacity.

A document's ids are cut into full sequences and a rest; the rest is cut into pieces
that fit a reciprocal of the capacity closely. A piece's class is how many of its
kind share one sequence, so the sequence of the i-th piece of class k is i // k: no
worker needs to know what another one packs.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from rostrum.llm.word_ids import Memory, cut_at
from rostrum.session import durable

CAPACITY = 1024
END = 0
# A piece may leave so large a part of its share of a sequence empty; beyond it is cut.
SLACK = 1 / 32
BATCH = 64
MOST_WORDS = 1 << 17  # in each half of a worker's memory; workers serve many operators in turn
SLICE_ROWS = 1 << 20
BROADCAST_ROWS = 1 << 20


@lru_cache(maxsize=8)
def class_counts(capacity: int = CAPACITY) -> tuple[int, ...]:
    """Pieces per sequence, by class: every number that is the most of some length, so a
    piece within a 32nd of the capacity wastes less than a piece of a sequence."""
    return tuple(sorted({capacity // n for n in range(1, capacity + 1)}))


def cut(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """`(length, class)` of the pieces of n ids, in order."""
    counts = class_counts(capacity)
    pieces = [(capacity, 0)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = bisect_left(counts, capacity // rest)
        if counts[k] * rest >= capacity * (1 - slack):
            pieces.append((rest, k))
            break
        size = capacity // counts[k + 1]
        pieces.append((size, k + 1))
        rest -= size
    return pieces


class Ids:
    """Token ids of texts by a byte-level BPE whose pieces never go on from a character to a
    blank behind it. So texts are cut before every run of white space and looked up word by
    word, each with the white space before it.

    `vocabulary` is the tokenizer file; `ranks`, if given, the same vocabulary as ranks
    for the faster library, which then encodes the new words of a batch at once.
    """

    # The joiner, what Python alone takes for white space, and what may be the
    # text of a special token. A text with one of them is encoded whole.
    whole = ("<|", "\0", "\x1c", "\x1d", "\x1e", "\x1f")
    word = re.compile(r"\s*\S+|\s+")

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.ranks = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            # The joiner is a piece of its own and part of no other.
            self.ranks = tiktoken.Encoding(
                "ranks", pat_str=r"\x00|" + pattern.replace(r"[^\s", r"[^\x00\s"), mergeable_ranks=table,
                special_tokens={},
            )
            self.joiner = table[b"\0"]
        self.memory = Memory(self.words, MOST_WORDS)

    def slow(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False) if texts else []
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def words(self, words: list[str]) -> list[bytes]:
        if self.ranks is None:
            return self.slow(words)
        # White space at a text's end would meet what follows it.
        last = [w for w in words if w[-1].isspace()]
        out = dict(zip(last, self.slow(last)))
        rest = [w for w in words if w not in out] if last else words
        if rest:
            ids = np.array(self.ranks.encode_ordinary("\0".join(rest) + "\0"), "<u4")
            own = cut_at(ids, np.flatnonzero(ids == self.joiner))
            if not last:
                return own
            out |= zip(rest, own)
        return [out[w] for w in words]

    def many(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        odd = [i for i, t in enumerate(texts) if any(x in t for x in self.whole)]
        words = [self.word.findall(t) for t in texts]
        for i in odd:
            words[i] = []
        out = self.memory(words)
        for i, ids in zip(odd, self.slow([texts[i] for i in odd])):
            out[i] = ids
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=4)
def ids_of(vocabulary: str, ranks: str | None, pattern: str | None) -> Ids:
    return Ids(vocabulary, ranks, pattern)


PIECES = ("doc bigint, start bigint, length bigint, class int, ids_crc32 bigint, "
          "doc_tokens bigint, ids array<int>")


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None,
           id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and one end id, each in exactly one piece.

    A null or empty text is the end id alone. Rows that repeat are packed once each.
    `with_ids` adds the ids themselves; else that column is null.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(vocabulary, ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                rows = []
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc, ids in zip(batch.column(0).to_pylist(), encode.many(texts)):
                    ids += END.to_bytes(4, "little")
                    total, start = len(ids) // 4, 0
                    for length, k in cut(total, capacity):
                        own = ids[4 * start:4 * (start + length)]
                        rows.append((
                            doc, start, length, k, zlib.crc32(own), total,
                            np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None,
                        ))
                        start += length
                cells = list(zip(*rows)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                         pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(cells, kinds)],
                    ["doc", "start", "length", "class", "ids_crc32", "doc_tokens", "ids"],
                )

    return docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")
    ).mapInArrow(make, PIECES)


def positions(df: DataFrame, group: str, order: Sequence[str], into: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in slices of their hash that
    are numbered on their own. `df` is read twice and should be a written table."""
    slices = max(64, df.count() // SLICE_ROWS)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = sliced.groupBy(group, "_slice").agg(F.count("*").alias("_rows")).select(
        group, "_slice",
        (F.sum("_rows").over(W.partitionBy(group).orderBy("_slice")) - F.col("_rows")).alias("_base"),
    )
    if slices <= BROADCAST_ROWS // 64:
        counts = F.broadcast(counts)  # slices times groups rows, and few groups
    inside = F.row_number().over(W.partitionBy(group, "_slice").orderBy(*order))
    return sliced.withColumn("_place", inside).join(counts, [group, "_slice"]).withColumn(
        into, F.col("_base") + F.col("_place") - 1
    ).drop("_slice", "_place", "_base")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to `pieces`: where each piece lies. At most one
    sequence per class is not full of its class's count."""
    counts = class_counts(capacity)
    numbered = positions(
        durable(parts, "pieces"), "class", ["doc", "start", "ids_crc32", "length"], "_i"
    )
    share = F.get(F.array(*[F.lit(c) for c in counts]), F.col("class"))
    sequence = F.floor(F.col("_i") / share) * len(counts) + F.col("class")
    before = W.partitionBy("sequence_id").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    return numbered.withColumn("sequence_id", sequence).withColumn(
        "offset", F.coalesce(F.sum("length").over(before), F.lit(0))
    ).drop("_i")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = END) -> DataFrame:
    """`(sequence_id, tokens, used)`: the sequences of `pack` over pieces with ids,
    padded to the capacity unless their length is a power of two."""
    joined = packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]
        )).alias("tokens")
    ).withColumn("used", F.size("tokens"))
    round_length = F.bit_count("used") == 1
    filler = F.array_repeat(F.lit(pad), F.when(round_length, 0).otherwise(capacity - F.col("used")))
    return joined.select("sequence_id", F.concat("tokens", filler).alias("tokens"), "used")
