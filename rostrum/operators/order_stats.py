"""Count, mean, deviation and exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rostrum.functions.numeric import col, finite, order_slot
from rostrum.session import durable

PARTS = 4096


def describe(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = (0.1, 0.9)
) -> DataFrame:
    """Per group: `n`, `mean`, population `std` and `p<100q>` by linear interpolation.

    No task ever holds a whole group. Rows are aggregated straight into order slots
    (see `order_slot`); the slot counts show which slots hold the ranks asked for. The
    rows of those are cut into PARTS equal parts between the slot's least and largest
    value, however narrow that is, and only the parts that hold a rank are sorted. A group
    with a NaN or an infinity keeps its `n` and has NULL for the rest.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    ok = finite("v").isNotNull()
    rows = rows.select(*keys, F.when(ok, order_slot("v")).alias("slot"), finite("v").alias("v"))
    cell_keys = [*keys, "slot"]
    # One row per task and cell reaches the shuffle; moments merge without a common centre.
    cells = rows.groupBy(*cell_keys).agg(
        F.count("*").alias("cn"), F.avg("v").alias("cmean"),
        (F.var_pop("v") * F.count("v")).alias("cdev"), F.min("v").alias("lo"), F.max("v").alias("hi"),
    ).withColumns({
        "cmean": F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("cmean")),
        "cdev": F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.col("cdev")),
    })
    # A few thousand cells at most per group meet here, however many rows it has.
    group = W.partitionBy(*keys)
    # The ordered window goes first: its sort serves the other one as well.
    cells = cells.withColumn("before", _below("cn", keys, "slot")).select(
        "*",
        F.sum("cn").over(group).alias("n"),
        (F.sum(F.col("cn") * F.col("cmean")).over(group) / F.sum("cn").over(group)).alias("gmean"),
        F.max(F.col("slot").isNull()).over(group).alias("spoilt"),
    )
    ranks = {
        f"r{i}_{side}": F.floor(F.lit(q) * (F.col("n") - 1)) + (
            F.lit(0) if side == "lo" else
            # The upper neighbour, unless the rank is whole.
            F.ceil(F.lit(q) * (F.col("n") - 1)) - F.floor(F.lit(q) * (F.col("n") - 1))
        )
        for i, q in enumerate(quantiles) for side in ("lo", "hi")
    }
    wanted = F.array(*[
        F.struct(F.lit(r).alias("r"), rank.cast("bigint").alias("at")) for r, rank in ranks.items()
    ])
    cells = cells.select(
        *cell_keys, "cn", "cmean", "cdev", "lo", "hi", "n", "gmean", "spoilt",
        F.transform(
            F.filter(wanted, lambda x: (F.col("before") <= x["at"]) & (x["at"] < F.col("before") + F.col("cn"))),
            lambda x: F.struct(x["r"].alias("r"), (x["at"] - F.col("before")).alias("at")),
        ).alias("wanted"),
    )
    cells = durable(cells, "cells")
    summary = cells.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.first("gmean").alias("mean"),
        F.sqrt(F.sum(
            F.col("cdev") + F.col("cn") * (F.col("cmean") - F.col("gmean"))
            * (F.col("cmean") - F.col("gmean"))
        ) / F.first("n")).alias("std"),
        F.max("spoilt").alias("spoilt"),
    )
    found = [_known(cells, keys)]
    lookups = _unknown(cells, cell_keys)
    # Rows of the cells that hold a rank, cut again between the cell's own ends.
    inside = durable(rows.join(lookups, [same_key(k) for k in cell_keys]).select(
        *cell_keys, "v", "wanted", equal_part("v", "lo", "hi").alias("part")
    ), "ranked")
    parts = inside.groupBy(*cell_keys, "part").agg(
        F.count("*").alias("cn"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.first("wanted").alias("wanted"),
    ).withColumn("before", _below("cn", cell_keys, "part")).withColumn("wanted", _moved("cn"))
    parts = durable(parts.where(F.size("wanted") > 0), "parts")
    found.append(_known(parts, keys))
    # What is still between two values is sorted: a few of a cell's values each.
    part_keys = [*cell_keys, "part"]
    last = inside.drop("wanted").join(_unknown(parts, part_keys), [same_key(k) for k in part_keys]).groupBy(
        *part_keys, "v"
    ).agg(F.count("*").alias("cn"), F.first("wanted").alias("wanted")).withColumn(
        "before", _below("cn", part_keys, "v")
    ).withColumn("wanted", _moved("cn"))
    found.append(last.select(*keys, F.explode("wanted").alias("w"), "v").select(*keys, "w.r", "v"))
    values = reduce(DataFrame.unionAll, found).groupBy(*keys).agg(*[
        F.max(F.when(F.col("r") == r, F.col("v"))).alias(r) for r in ranks
    ])
    stats = summary.unionByName(values, allowMissingColumns=True).groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("std").alias("std"),
        F.max("spoilt").alias("spoilt"), *[F.max(r).alias(r) for r in ranks],
    )
    out = {"mean": F.col("mean"), "std": F.col("std")}
    for i, q in enumerate(quantiles):
        h = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.col(f"r{i}_lo"), F.col(f"r{i}_hi")
        out[f"p{round(q * 100)}"] = lo + (hi - lo) * (h - F.floor(h))
    return stats.select(*keys, "n", *[
        F.when(~F.col("spoilt"), e).alias(name) for name, e in out.items()
    ])


def _below(count: str, keys: Sequence[str], order: str) -> Column:
    """Rows in the cells of a group before this one."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(before), F.lit(0))


def equal_part(v: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """Which of PARTS equal parts of [lo, hi] a value lies in; never falls as v grows."""
    v, lo, hi = col(v), col(lo), col(hi)
    # Halves first: the width of a cell may be over the largest double.
    share = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * PARTS), F.lit(PARTS - 1)).cast("int")


def _moved(count: str) -> Column:
    """The wanted ranks that lie in this cell, counted from its start."""
    mine = F.filter("wanted", lambda x: (F.col("before") <= x["at"]) & (x["at"] < F.col("before") + F.col(count)))
    return F.transform(mine, lambda x: F.struct(x["r"].alias("r"), (x["at"] - F.col("before")).alias("at")))


def _at_an_end(x: Column) -> Column:
    return (x["at"] == 0) | (x["at"] == F.col("cn") - 1) | (F.col("lo") == F.col("hi"))


def _known(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`(keys, r, v)` of the ranks at a cell's ends."""
    ends = cells.select(*keys, "lo", "hi", F.explode(F.filter("wanted", _at_an_end)).alias("w"))
    return ends.select(*keys, "w.r", F.when(F.col("w.at") == 0, F.col("lo")).otherwise(F.col("hi")).alias("v"))


def _unknown(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with a rank between their ends, under other names for a join."""
    return cells.select(
        *[F.col(k).alias(f"_{k}") for k in keys], "lo", "hi",
        F.filter("wanted", lambda x: ~_at_an_end(x)).alias("wanted"),
    ).where(F.size("wanted") > 0)


def same_key(k: str) -> Column:
    # Null-safe, so that a NULL group counts as a group.
    return F.col(k).eqNullSafe(F.col(f"_{k}"))


SKETCH_K = 800  # a rank is off by about 0.2 % of a group's rows


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """`(keys, n, mean, dev, sketch)`: what a group's percentiles can be told from later, in some
    kilobytes. Written beside a day's predictions, it spares reading them again when the next
    day's come. A NaN or an infinity counts in `spoilt`."""
    v = finite(F.col(value).cast("double"))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("dev"),
        F.count_if(v.isNull()).alias("spoilt"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of parts as sketches of the whole: the rows of `quantile_sketches`, one a group."""
    keys = list(keys)
    whole = sketches.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum(
        F.when(F.col("mean").isNotNull(), F.col("n")))).alias("_mean"))
    both = sketches.join(
        whole.select(*[F.col(c).alias(f"_{c}") for c in keys], "_mean"), [same_key(c) for c in keys]
    )
    apart = F.col("mean") - F.col("_mean")
    return both.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"),
        F.sum(F.col("dev") + F.col("n") * apart * apart).alias("dev"), F.sum("spoilt").alias("spoilt"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def described_sketches(sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.1, 0.9)) -> DataFrame:
    """The columns of `describe`; percentiles are values whose rank is near the one asked for."""
    sound = F.col("spoilt") == 0
    return sketches.select(
        *keys, "n", F.when(sound, F.col("mean")).alias("mean"),
        F.when(sound, F.sqrt(F.col("dev") / F.col("n"))).alias("std"),
        *[F.when(sound, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).alias(f"p{round(q * 100)}")
          for q in quantiles],
    )
