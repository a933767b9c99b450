"""Near-duplicate documents: sketches, banding, exact checks, components.

Documents with equal shingle sets form a class, found by one aggregation; only class
representatives (the least id) are compared. Representatives that share a band of their
sketches meet in a bucket. A bucket's members are compared with its hub (its least id)
and not with each other. In buckets that still hold several components, members are
described by what sets them apart from the hub; two of them can only be similar if they
share much of that, so they are joined on the rarest elements of these small sets, and
what meets there is compared in full. So a group of thousands of near copies costs about
one comparison per member, and still no pair is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from rostrum.llm.components import components
from rostrum.llm.registry import fresh
from rostrum.llm.shingles import bands, shingle_set, sketch
from rostrum.session import discard, durable

LEAST_PERCENT = 75

SKETCHED = "doc bigint, n bigint, digest binary, bands array<bigint>"
SETS = "doc bigint, set binary"
BATCH = 256


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str | None]]:
    for part in range(0, batch.num_rows, BATCH):
        piece = batch.slice(part, BATCH)
        yield from zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, sizes, digests, hashes = [], [], [], []
        for doc, text in _texts(batch):
            x = shingle_set(text)
            docs.append(doc)
            sizes.append(len(x))
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
            hashes.append(bands(sketch(x)).view(np.int64) if len(x) else None)
        yield pa.RecordBatch.from_arrays([
            pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
            pa.array(hashes, pa.list_(pa.int64())),
        ], ["doc", "n", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc, shingle_set(text).tobytes()) for doc, text in _texts(batch)]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
        ], ["doc", "set"])


def _linked(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of `(a, b, set_a, set_b)` the pairs that are similar enough, on their full sets."""
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            if len(x) and 100 * both >= least * (len(x) + len(y) - both):
                keep.append(i)
        out = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(out.columns[:2], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame, least: int = LEAST_PERCENT) -> DataFrame:
    """The pairs `(a, b)` whose texts are similar enough. `texts`: id and text. Only the
    texts of ids that occur in `pairs` are read into sets."""
    one, two = _pair_sets(pairs, texts)
    return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(
        lambda batches: _linked(batches, least), "a bigint, b bigint"
    ).distinct()


def _pair_sets(pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    key, text = texts.columns
    sets = texts.join(ids, F.col(key) == F.col("doc"), "left_semi").select(
        F.col(key).alias("doc"), F.col(text).alias("text")
    ).mapInArrow(_sets, SETS)
    return (
        sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a")),
        sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b")),
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                    least: int = LEAST_PERCENT) -> DataFrame:
    """`(doc, n_shingles, component, kept)`, one row per row of `docs`.

    Documents whose shingle sets have at least `least` percent in common (intersection
    to union) are linked; `component` is the least id reachable, `kept` says that it is
    the row's own. Texts without words are empty sets and linked with nothing. Rows of
    one id are one document: what any of their texts links to, they all do. Rows without
    an id are linked with nothing: their component is null and they are kept.

    A pair exactly at 75 percent meets in none of the bands with probability 5e-6, a
    more similar one more rarely; what meets is checked on full sets.
    """
    texts = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"),
                        F.col(f"`{text}`").alias("text"))
    sketched = durable(texts.mapInArrow(_sketches, SKETCHED), "sketches")
    linkable = sketched.where(F.col("digest").isNotNull() & F.col("doc").isNotNull())
    # Written, so that a large class is split when it is joined.
    classes = durable(linkable.groupBy("digest").agg(
        F.min("doc").alias("rep"), F.count("*").alias("rows")
    ).where("rows > 1").select("digest", "rep"), "reps")
    in_class = durable(
        sketched.select("doc", "n", "digest").join(classes, "digest", "left").select(
            "doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")).alias("rep")
        ), "classes",
    )
    # An id with several texts ties their classes together.
    several = in_class.groupBy("doc").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where(
        "lo <> hi"
    ).select("doc")
    ties = in_class.join(several, "doc", "left_semi").select(
        F.col("doc").alias("a"), F.col("rep").alias("b")
    )

    reps = linkable.join(classes, "digest", "left").where("rep is null or rep = doc")
    rows = reps.select("doc", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(
        F.min("doc").alias("hub"), F.max("doc").alias("top")
    ).where("hub <> top").select("band", "hub")
    members = durable(rows.join(shared, "band").distinct(), "buckets")

    first = durable(members.where("doc <> hub").groupBy("doc").agg(F.min("hub").alias("b"))
                    .select(F.col("doc").alias("a"), "b"), "pairs")
    links = durable(confirmed(first, texts, least).unionAll(ties), "links")
    labels = components(links)

    apart = durable(_apart_from_centre(members, first, labels, texts, least), "apart")
    links = links.unionAll(apart.where("linked").select(
        F.col("doc").alias("a"), F.col("centre").alias("b")
    ))
    across = durable(_across(apart), "pairs")
    if not across.isEmpty():
        links = links.unionAll(durable(confirmed(across, texts, least), "links"))
    labels = components(links)
    component = F.coalesce("component", "rep")
    out = in_class.join(labels, F.col("rep") == F.col("id"), "left").select(
        "doc", F.col("n").alias("n_shingles"), component.alias("component"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )
    discard(sketched, classes, members, first, apart, across)
    return out


APART = ("v bigint, hv bigint, mode int, doc bigint, centre bigint, label bigint, linked boolean, asks boolean, "
         "size int, share double, short int, long int, elements array<bigint>")
BY_CENTRE, WHOLE = 0, 1


def _apart(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of `(a, b, label, set_a, set_b)` what sets a apart from its bucket's centre b.

    With c = least / (100 + least), and r elements of the centre missing in x and s added,
    x and y are similar enough only if they share g(x) + g(y) - (1 - 2c) |b| of them,
    where g = (1 - c) r + c s: the weight. The last term is the slack. So x and the
    centre itself are similar enough if and only if the weight is within the slack; of two
    such nothing more need be known. Any other pair shares more than either one's weight,
    of the farther one less the slack: `short` and `long` say how many of a member's
    rarest elements must hold one of them.

    Distances obey the triangle rule: a member over twice the allowed distance from the
    centre is similar to none that is linked to it. It meets the others by its whole set,
    of which similar ones share `least` percent.
    """
    c = least / (100 + least)
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            x, y = (batch.column(k)[i].as_buffer() for k in (3, 4))
            versions = [int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) for s in (x, y)]
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            missing, added = np.setdiff1d(y, x, True), np.setdiff1d(x, y, True)
            ids = [batch.column(k)[i].as_py() for k in range(3)]
            size, both, either = len(missing) + len(added), len(y) - len(missing), len(y) + len(added)
            linked = 100 * both >= least * either
            outer = 100 * both < (2 * least - 100) * either
            if not outer:
                weight = (1 - c) * len(missing) + c * len(added) - 1e-9  # rounding only lengthens a prefix
                beyond = max(0.0, weight - (1 - 2 * c) * len(y))
                rows.append((*versions, BY_CENTRE, *ids, linked, not linked, size,
                             weight - (1 - 2 * c) * len(y) / 2, size - int(weight), size - int(beyond), np.concatenate([missing, added]).view(np.int64)))
            if not linked:
                short = len(x) - -(-least * len(x) // 100) + 1
                rows.append((*versions, WHOLE, *ids, False, outer, len(x), c * len(x) - 1e-9, short, short, x.view(np.int64)))
        kinds = [*[pa.int64()] * 2, pa.int32(), *[pa.int64()] * 3, *[pa.bool_()] * 2, pa.int32(), pa.float64(),
                 *[pa.int32()] * 2, pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows
            else [pa.array([], k) for k in kinds],
            [part.split()[0] for part in APART.split(", ")],
        )


def _apart_from_centre(members: DataFrame, first: DataFrame, labels: DataFrame, texts: DataFrame,
                       least: int) -> DataFrame:
    """APART rows of the members of buckets that hold several components. A bucket's centre
    is the root of the component that most of its members were first compared with: all
    that follows holds for any centre, and is short for one that they resemble."""
    label = labels.select(F.col("id").alias("doc"), "component")
    hub_label = label.select(F.col("doc").alias("b"), F.col("component").alias("hub_component"))
    known = members.select("doc").distinct().join(label, "doc", "left").join(
        first.select(F.col("a").alias("doc"), "b"), "doc", "left"
    ).join(hub_label, "b", "left").select(
        "doc", F.coalesce("component", "doc").alias("label"),
        F.coalesce("hub_component", "b", "component", "doc").alias("family"),
    )
    named = members.select("band", "doc").join(known, "doc")
    mixed = named.groupBy("band", "family").agg(
        F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")
    ).groupBy("band").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max_by("family", F.struct("n", -F.col("family"))).alias("centre"),
    ).where("lo <> hi").select("band", "centre")
    pairs = durable(named.join(mixed, "band").where("doc <> centre").select(
        F.col("doc").alias("a"), F.col("centre").alias("b"), "label"
    ).distinct(), "pairs")
    one, two = _pair_sets(pairs, texts)
    return pairs.join(one, "a").join(two, "b").select("a", "b", "label", "set_a", "set_b").mapInArrow(
        lambda batches: _apart(batches, least), APART
    )


def _across(apart: DataFrame) -> DataFrame:
    """Pairs `(a, b)` of members of one centre's buckets, in different components, that may
    be similar enough; a superset of those that are.

    Elements are put in order of rarity around the centre; a pair that shares t of a
    member's n elements shares one of its n - t + 1 rarest. Elements that only one member
    has come first and meet nothing, so they are only counted. The first element a pair
    has in common leaves so many behind it; if they cannot add up to what the pair must
    share, the sum of both shares, it is none.
    """
    around = ["hv", "mode", "element"]
    rows = apart.select("hv", "mode", "doc", "v", "label", "asks", "size", "share", "short",
                        "long", F.explode("elements").alias("element"))
    common = durable(rows.groupBy(*around).agg(F.count("*").alias("holders")).where("holders > 1"), "common")
    own = W.partitionBy("hv", "mode", "doc", "v")
    rank = F.row_number().over(own.orderBy("holders", "element")) + F.col("size") - F.count("*").over(own)
    ranked = durable(
        rows.join(common, around).withColumn("rank", rank).where(
            F.col("rank") <= F.when(F.col("asks"), F.col("long")).otherwise(F.col("short"))
        ).select(*around, "doc", "label", "asks", "share", (F.col("size") - F.col("rank") + 1).alias("rest"), (F.col("rank") <= F.col("short")).alias("near")), "prefixes",
    )
    left = ranked.where("asks")
    right = ranked.where("near").select(*around, *[F.col(c).alias(f"{c}2") for c in ("doc", "label", "asks", "share", "rest")])
    return left.join(right, around).where(
        "label <> label2 and (not asks2 or (near and doc < doc2)) and least(rest, rest2) >= share + share2 - 1e-6"
    ).select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                         least: int = LEAST_PERCENT) -> DataFrame:
    """`docs` with one row of each group of near-duplicates; rows that repeat the kept
    id go as well, but for the one with the least text. All columns pass through."""
    doc, first = fresh(docs, "doc_", "first_")
    kept = near_duplicates(docs, id_column, text, least).where("kept")
    ids = kept.where(F.col("doc").isNotNull()).groupBy("doc").agg(F.count("*").alias("n"))
    once = ids.where("n = 1").select(F.col("doc").alias(doc))
    own = docs.withColumn(doc, F.col(f"`{id_column}`").cast("bigint"))
    more = ids.where("n > 1").select(F.col("doc").alias(doc))
    chosen = own.join(more, doc, "left_semi").groupBy(doc).agg(
        F.min(F.struct(*[F.col(f"`{c}`") for c in (text, *[x for x in docs.columns if x != text])])).alias(first)
    ).select(*[F.col(f"{first}.`{c}`").alias(c) for c in docs.columns])
    return own.join(once, doc, "left_semi").select(*docs.columns).unionByName(
        chosen.select(*docs.columns)
    ).unionByName(docs.where(F.col(f"`{id_column}`").isNull()))
