"""Documents that hold benchmark items, also with other numbers, names or units.

Tokens become typed placeholders; windows of five canonical tokens of both sides meet in
a hash join. Windows on one diagonal (document position minus item position) must map
the item's slot values to the document's one to one throughout. A word that begins a
sentence is read twice, as a word and as a name. Windows of plain tokens are matched as
well, so that a change of case does not hide an item.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rostrum.llm.registry import fresh
from rostrum.llm.shingles import BAND_SEEDS, SEEDS, mix, powers
from rostrum.session import durable

WORDS = 5
LEAST_LITERALS = 3  # of a typed window's tokens, which is widened to hold them; placeholders alone say nothing
LEAST_COVERAGE = 0.75
LEAST_RUN = 13  # tokens in a row that tell an item of which less is left
FILTER_BITS = 22
BROADCAST_ROWS = 200_000
BATCH = 128
BATCH_CHARS = 1 << 18
MOST_CHUNKS = 1 << 18  # chunks a worker remembers; workers serve many operators in turn

# Units that follow a number, and numbers in words.
UNITS = set("""mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz pound pounds ton
tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days
week weeks month months year years mph kph kmh usd eur gbp dollar dollars euro euros cent cents percent degree
degrees volt volts watt watts joule joules newton newtons kb mb gb tb""".split())
NUMBER_WORDS = set("""one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen
sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand
million""".split())

# Letters and marks of scripts that put no blanks between words are tokens of their own: Thai, Lao, Burmese,
# Khmer, Japanese, Bopomofo, Chinese.
UNSPACED = ("\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ecf\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u109a-\u109f\u1780-\u17d3"
            "\u3005-\u3007\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
            "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
TOKEN = re.compile(rf"[^\W\d_{UNSPACED}]+|[{UNSPACED}]|[.!?\n%$€£°]|\d+(?:[.,:/]\d+)*")
SMALL, CAPITAL, NUMBER, UNIT, STOP = range(5)
CLASS = np.uint64(7)
NAME_CODE, NUMBER_CODE, UNIT_CODE = (np.uint64(x) for x in SEEDS[-3:])
PLACES = BAND_SEEDS[:WORDS]
PLAIN, TYPED, NAMED = 0, 1, 2
MODE_SEEDS = BAND_SEEDS[WORDS:WORDS + 3]
WHOLE_SEED = BAND_SEEDS[WORDS + 3]
WIDE_SEEDS = BAND_SEEDS[WORDS + 4:WORDS + 5 + LEAST_LITERALS]

WINDOWS = "doc bigint, version bigint, mode int, hash bigint, pos int, slots int, plain array<bigint>, hashed int"


class _Codes(dict):
    """What stands between two blanks to its tokens: hashes of their lower-case forms, with
    their class in the lowest three bits."""

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        codes = tuple(map(self.code, TOKEN.findall(chunk)))
        if len(self) < MOST_CHUNKS and len(chunk) < 64:
            self[chunk] = codes
        return codes

    @staticmethod
    @lru_cache(1 << 14)  # characters of unspaced scripts come back in ever new chunks
    def code(token: str) -> int:
        low = token.lower()
        if token in ".!?\n":
            kind = STOP
        elif token[0].isdigit() or low in NUMBER_WORDS:
            kind = NUMBER
        elif token in "%$€£°" or low in UNITS:
            kind = UNIT
        else:
            kind = CAPITAL if token[0].isupper() and not (len(token) > 1 and token.isupper()) else SMALL
        digest = blake2b(low.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return int.from_bytes(digest, "little") & ~7 | kind


# A worker keeps its codes from task to task.
_codes = _Codes()


def canonical(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Tokens of all the texts in a row: the text each is from, plain codes, and typed codes
    by mode. A capitalised word inside a sentence is a name, in NAMED also one that begins
    a sentence; a unit is one only next to a number."""
    raw, ends = [], []
    for text in texts:
        raw.extend(chain.from_iterable(map(_codes.__getitem__, (text or "").replace("\n", " \n ").split(" "))))
        ends.append(len(raw))
    own = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    raw = np.array(raw, np.uint64)
    kind = raw & CLASS
    same = own[1:] == own[:-1]
    inside = np.zeros(len(raw), bool)
    inside[1:] = same & (kind[:-1] != STOP)
    number = kind == NUMBER
    beside = np.zeros(len(raw), bool)
    beside[1:] = same & number[:-1]
    beside[:-1] |= same & number[1:]
    plain = raw & ~CLASS
    typed = plain.copy()
    typed[(kind == CAPITAL) & inside] = NAME_CODE
    typed[number] = NUMBER_CODE
    typed[(kind == UNIT) & beside] = UNIT_CODE
    named = typed.copy()
    named[kind == CAPITAL] = NAME_CODE
    keep = kind != STOP
    return own[keep], plain[keep], {TYPED: typed[keep], NAMED: named[keep]}


def _windows(codes: np.ndarray, mode: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows, or of those that begin at `at`."""
    n = len(codes) - WORDS + 1
    h = np.full(max(n, 0) if at is None else len(at), MODE_SEEDS[mode], np.uint64)
    for i in range(WORDS):
        if len(h):
            h += (codes[i:i + n] if at is None else codes[at + i]) * PLACES[i]
    return mix(h)


def _spans(codes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from first and last places of any spans to their hashes, not yet mixed."""
    power, inverse = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[:len(codes)], out=sums[1:])
    return lambda first, last: (sums[last] - sums[first]) * inverse[first]


class Wanted(NamedTuple):
    """What documents need of the benchmark: a bit table of hashes, the most tokens of a
    widened window, and (mode, tokens) of the items that are one window."""

    bits: np.ndarray
    widest: int
    whole: list[tuple[int, int]]


def _forms(texts: list[str | None], wanted: Wanted | None) -> Iterator[tuple]:
    """Windows of the texts, as arrays: text, mode, hash, first token's position, slots, and
    tokens of the place (two-dimensional), tokens hashed (negative: the whole item).

    A typed window of fewer than LEAST_LITERALS literals is widened over the next ones
    on its left and right, in each way to share them out; its place stays. An item that has
    too few of them is one typed window, repeated for each place. An item of fewer than
    WORDS tokens is one window, typed if it has enough literals.
    """
    own, plain, readings = canonical(texts)
    size = np.bincount(own, minlength=len(texts))
    begin = np.cumsum(size) - size
    pos, stop = np.arange(len(own)) - begin[own], (begin + size)[own]

    def out(mode: int, h: np.ndarray, at: np.ndarray, slot: np.ndarray | None, hashed, width: int = WORDS) -> tuple:
        if wanted:
            bit = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            some = np.flatnonzero((wanted.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            h, at = h[some], at[some]
            hashed = hashed if np.isscalar(hashed) else hashed[some]
        some = at[:, None] + np.arange(width)
        slots = np.zeros(len(at), int) if slot is None else slot[some] @ (1 << np.arange(width))
        return own[at], mode, h, pos[at], slots, plain[some], np.broadcast_to(hashed, len(at))

    def whole(mode: int, codes: np.ndarray, slot: np.ndarray | None, n: int, at: np.ndarray) -> Iterator[tuple]:
        base = _spans(codes)(at, at + n) + MODE_SEEDS[mode] + WHOLE_SEED
        for i in range(max(1, n - WORDS + 1)):
            yield out(mode, mix(base + np.uint64(i) * PLACES[0]), at + i, slot, -n, min(n, WORDS))

    full = np.flatnonzero(pos + WORDS <= size[own])
    if len(full):
        yield out(PLAIN, _windows(plain, PLAIN)[full], full, None, WORDS)
    for n in range(1, WORDS if not wanted else 0):
        yield from whole(PLAIN, plain, None, n, begin[size == n])
    for mode, codes in readings.items():
        slot = codes != plain
        if not slot.any():
            continue
        literals = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(~slot, out=literals[1:])
        held = literals[full + WORDS] - literals[full]
        at = full[(held < WORDS) & (held >= LEAST_LITERALS)]
        yield out(mode, _windows(codes, mode, at), at, slot, WORDS)
        poor, lack = full[held < LEAST_LITERALS], LEAST_LITERALS - held[held < LEAST_LITERALS]
        if len(poor):
            span = _spans(codes)
        for left in range(LEAST_LITERALS + 1 if len(poor) else 0):
            at, right = poor[lack >= left], lack[lack >= left] - left
            to = at + WORDS
            first = np.searchsorted(literals, literals[at] - left, "right") - 1 if left else at
            last = np.where(right > 0, np.searchsorted(literals, literals[to] + right), to)
            ok = (literals[at] - left >= literals[begin[own[at]]]) & (last <= stop[at])
            if wanted:
                ok &= last - first <= wanted.widest
            at, first, last = at[ok], first[ok], last[ok]
            h = mix(span(first, last) + MODE_SEEDS[mode] + WIDE_SEEDS[left])
            yield out(mode, h, at, slot, last - first)
        if not wanted:
            some = literals[begin + size] - literals[begin]
            few = (size >= WORDS) & (some > 0) & (some < LEAST_LITERALS)
            few |= (size < WORDS) & (some < size) & (some >= LEAST_LITERALS)
            for n in np.unique(size[few]).tolist():
                yield from whole(mode, codes, slot, n, begin[few & (size == n)])
    for mode, n in wanted.whole if wanted else []:
        codes = plain if mode == PLAIN else readings[mode]
        at = np.flatnonzero(pos + n <= size[own])
        if len(at):
            yield from whole(mode, codes, None if mode == PLAIN else codes != plain, n, at)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are read at once: BATCH of them, or less of long ones."""
    at = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if i + 1 - at == BATCH or held >= BATCH_CHARS or i + 1 == len(texts):
            yield at, i + 1
            at, held = i + 1, 0


def windows(texts: DataFrame, wanted: Wanted | None = None) -> DataFrame:
    """WINDOWS rows of `(id, version, text)`: of items, or of documents those that may be `wanted`."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)  # 2^FILTER_BITS bits whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            every = whole.column(2).to_pylist()
            for a, b in _groups(every):
                for own, mode, h, pos, slots, plain, hashed in _forms(every[a:b], shared.value):
                    if len(h):
                        offsets = np.arange(len(h) + 1, dtype=np.int32) * plain.shape[1]
                        rows = pa.array(own + a)
                        yield pa.RecordBatch.from_arrays([
                            whole.column(0).take(rows), whole.column(1).take(rows), pa.array(np.full(len(h), mode, np.int32)),
                            pa.array(h.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(slots.astype(np.int32)),
                            pa.ListArray.from_arrays(offsets, plain.ravel().view(np.int64)), pa.array(hashed.astype(np.int32)),
                        ], ["doc", "version", "mode", "hash", "pos", "slots", "plain", "hashed"])

    return texts.mapInArrow(run, WINDOWS)


def _longest(places: Column) -> Column:
    """The most consecutive numbers in a sorted array."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(state: Column, at: Column) -> Column:
        n = F.when(at == state["last"] + 1, state["n"] + 1).otherwise(1)
        return F.struct(at.alias("last"), n.alias("n"), F.greatest(state["most"], n).alias("most"))
    return F.aggregate(places, start, step, lambda state: state["most"])


def _version(text: Column) -> Column:
    """Tells the texts of one id from each other."""
    return F.xxhash64(text)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_COVERAGE, least_run: int = LEAST_RUN
          ) -> DataFrame:
    """`(doc, version, item, coverage, run, template)` of documents that hold at least `least` of an
    item's windows, or `least_run` of its tokens in a row on one diagonal: a part of an item
    is left where other lines of it were dropped. `docs`, `benchmark`: id and text.
    `template`: numbers, names or units differ.

    An item's share counts its plain windows, or its windows with typed ones in the place
    of those that have slots. An item of fewer than five tokens is one window; null
    and empty texts match nothing. Rows of one id, or without one, that have different texts
    are different documents.
    """
    key, text = benchmark.columns
    items = durable(windows(benchmark.select(F.col(key).cast("bigint"), F.lit(0).cast("bigint"), F.col(text)))
                    .withColumnRenamed("doc", "item"), "items")
    # Cells of a bit table: at most 2^FILTER_BITS small numbers, whatever the benchmark's size.
    cells = items.select(
        F.shiftrightunsigned("hash", 64 - FILTER_BITS).cast("int").alias("bit")
    ).distinct().toArrow()["bit"].to_numpy()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    np.bitwise_or.at(bits, cells >> 3, (1 << (cells & 7)).astype(np.uint8))

    wide, odd = F.max("hashed").alias("widest"), F.collect_set(F.when(F.col("hashed") < 0, F.struct("mode", "hashed")))
    shape = items.agg(wide, odd.alias("whole")).first()
    wanted = Wanted(bits, shape["widest"] or WORDS, sorted((r["mode"], -r["hashed"]) for r in shape["whole"]))

    held = items.count()
    own = items.select(
        "item", "mode", "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"),
        F.col("plain").alias("item_plain"),
    )
    if held <= BROADCAST_ROWS:
        own = F.broadcast(own)
    doc, body = docs.columns
    found = windows(docs.select(F.col(doc).cast("bigint"), _version(F.col(body)), F.col(body)), wanted)
    # Slots of the window as (what the item has, what the document has).
    pairs = F.transform(F.filter(
        F.arrays_zip("item_plain", "plain", F.array(*[F.lit(i) for i in range(WORDS)]).alias("at")),
        lambda x: F.get(F.array(*[F.col("slots").bitwiseAND(F.lit(1 << i)) > 0 for i in range(WORDS)]), x["at"]),
    ), lambda x: F.struct(x["item_plain"].alias("a"), x["plain"].alias("b")))
    met = found.join(own, ["mode", "hash"]).where("slots = item_slots").select(
        "doc", "version", "item", "mode", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos",
        pairs.alias("pairs"),
    )
    # A diagonal meets each of the item's windows at most once per text.
    lines = met.groupBy("doc", "version", "item", "mode", "diagonal").agg(
        F.collect_set("item_pos").alias("places"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    distinct = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    consistent = lines.where((F.size("pairs") == distinct("a")) & (F.size("pairs") == distinct("b")))
    runs = consistent.groupBy("doc", "version", "item", "diagonal").agg(
        _longest(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places"))))).alias("run")
    ).groupBy("doc", "version", "item").agg((F.max("run") + (WORDS - 1)).alias("run"))
    places = consistent.select("doc", "version", "item", "mode", F.explode("places").alias("at")).distinct()
    # Per mode: a typed window stands in for the plain one at its place.
    seen = places.groupBy("doc", "version", "item", "at").agg(F.min("mode").alias("mode")).groupBy("doc", "version", "item").agg(
        F.count("*").alias("n"), F.max("mode").alias("mode")
    )
    sizes = items.groupBy("item").agg(F.count_distinct("pos").alias("windows"))
    covered = seen.join(sizes, "item").withColumn("coverage", F.col("n") / F.col("windows"))
    known = covered.withColumnsRenamed({"doc": "d", "version": "v", "item": "i"}).join(
        runs, F.col("d").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")) & (F.col("i") == F.col("item"))
    )
    return known.where((F.col("coverage") >= least) | (F.col("run") >= least_run)).select(
        "doc", "version", "item", "coverage", "run", (F.col("mode") >= TYPED).alias("template"),
    )


def verdicts(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """`(doc, version, n_items, item, coverage, template)` of contaminated documents; the item is the
    one covered best, ties to the smaller id."""
    best = F.max_by(F.struct("item", "coverage", "template"), F.struct("coverage", -F.col("item")))
    return leaks(docs, benchmark, least).groupBy("doc", "version").agg(
        F.count("*").alias("n_items"), best.alias("best")
    ).select("doc", "version", "n_items", "best.*")


def mark(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
         least: float = LEAST_COVERAGE) -> tuple[DataFrame, list[str]]:
    """`docs` with `contaminated`, `n_items`, `item_id`, `coverage`, `template` (underscores
    before names that are taken), and those names. Every row comes back once."""
    names = fresh(docs, "contaminated", "n_items", "item_id", "coverage", "template", "doc_", "version_")
    flag, n, item, coverage, template, doc, version = names
    found = durable(verdicts(docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`")), benchmark, least), "leaks")
    own = found.select(
        F.col("doc").alias(doc), F.col("version").alias(version), F.col("n_items").alias(n), F.col("item").alias(item),
        F.col("coverage").alias(coverage), F.col("template").alias(template),
    )
    joined = docs.join(own, F.col(f"`{id_column}`").cast("bigint").eqNullSafe(F.col(doc))
                       & (_version(F.col(f"`{text}`")) == F.col(version)), "left")
    return joined.withColumns({
        flag: F.col(n).isNotNull(), n: F.coalesce(F.col(n), F.lit(0).cast("bigint")),
    }).select(*docs.columns, *names[:-2]), names[:-2]
