"""Shards by jump consistent hashing, in Column expressions only.

A key walks through the jump points of a linear congruential generator seeded with
the key; the last point below the number of shards is its shard. With one more
shard a key either stays or goes into the new one. There is no table of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rostrum.session import durable

# Fixed values of the published generator: multiplier (64 bits) and increment.
MULTIPLIER = 2862933555777941757
INCREMENT = 1

LOW32 = (1 << 32) - 1
# A key jumps about ln(shards) times; more jumps than this do not happen
# (for 2^31 shards the chance is below 1e-50).
MOST_JUMPS = 128


def _mul32(a: Column, b: int) -> Column:
    """(a * b) mod 2^32 without leaving 63 bits, for a and b below 2^32."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b)
    high = (F.shiftright(a, 16) * F.lit(b)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(LOW32))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One step of the generator on a 64-bit state held as two 32-bit halves."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & LOW32
    p0 = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(m_lo)
    p1 = F.shiftright(lo, 16) * F.lit(m_lo)
    t = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(INCREMENT)
    carry = F.shiftright(t, 32) + F.shiftright(p1, 16)
    return (
        (carry + _mul32(hi, m_lo) + _mul32(lo, m_hi)).bitwiseAND(F.lit(LOW32)),
        t.bitwiseAND(F.lit(LOW32)),
    )


def key_halves(key: Column) -> tuple[Column, Column]:
    """Two 32-bit halves from the MD5 of the key's text; a null key counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return tuple(
        F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9)
    )


def jump(key: Column, shards: int) -> Column:
    """`struct<shard, grown>`: the key's shard, and its shard with one shard more."""
    if shards < 1:
        raise ValueError("at least one shard")
    n = F.lit(shards).cast("bigint")
    hi, lo = key_halves(key)
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        hi.alias("hi"), lo.alias("lo"), zero.alias("j"), zero.alias("shard"), zero.alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        b = s["j"]
        j = F.floor(
            (b + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))
        )
        return F.when(s["j"] > n, s).otherwise(F.struct(
            hi.alias("hi"), lo.alias("lo"), j.alias("j"),
            F.when(b < n, b).otherwise(s["shard"]).alias("shard"), b.alias("grown"),
        ))

    steps = F.sequence(F.lit(1), F.lit(min(shards + 1, MOST_JUMPS)))
    return F.aggregate(steps, start, step, lambda s: F.struct(
        s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown"),
    ))


def shards(df: DataFrame, key: str, n: int, into: str = "shard") -> DataFrame:
    """Add the shard number of column `key`; nothing moves. Null keys share a shard."""
    return df.withColumn(into, jump(F.col(key), n)["shard"])


def placements(rows: DataFrame, key: str, n: int, slices: int = 64) -> DataFrame:
    """Give each row of `rows` its shard, its slot there (gapless from 0) and its
    shard once there is one more.

    `rows` holds what identifies a row, and no payload. Equal rows are counted
    before anything moves, so repeated rows and keys weigh one row each. Slots follow
    (slice of the key's hash, then all columns): each slice of a shard is numbered on
    its own, and the slice counts - `n * slices` rows whatever the input - shift the
    numbers. An empty table gives an empty result.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    walk = jump(F.col(key), n)
    # Written, since both the slice counts and the numbers read it: one pass over the texts.
    placed = durable(counted.withColumn("_walk", walk).select(
        *columns, "_n", F.col("_walk.shard").alias("shard"), F.col("_walk.grown").alias("grown_shard"),
        (key_halves(F.col(key))[1] % slices).cast("int").alias("_slice"),
    ), "places")
    running = F.sum("_rows").over(W.partitionBy("shard").orderBy("_slice"))
    offsets = placed.groupBy("shard", "_slice").agg(F.sum("_n").alias("_rows")).select(
        "shard", "_slice", (running - F.col("_rows")).alias("_offset"),
    )
    inside = F.sum("_n").over(W.partitionBy("shard", "_slice").orderBy(*columns))
    return placed.withColumn("_upto", inside).join(
        F.broadcast(offsets), ["shard", "_slice"]  # n * slices rows at most
    ).withColumn("_last", F.col("_offset") + F.col("_upto") - 1).select(
        *columns, "shard",
        F.explode(F.sequence(F.col("_last") - F.col("_n") + 1, F.col("_last"))).alias("slot"),
        "grown_shard",
    )

