"""Scalar column expressions. Missing is NULL; NaN and infinity never leave."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from rostrum.vocab import LEVEL_RANGES, LEVELS, LOG_OFFSET

SLOTS_PER_OCTAVE = 128


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL (Spark sorts NaN above every number)."""
    c = col(c).cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def log(c: Column | str) -> Column:
    """Natural logarithm; NULL at zero and below."""
    return F.ln(col(c).cast("double"))


def log_offset(c: Column | str, eps: float = LOG_OFFSET) -> Column:
    return F.ln(col(c).cast("double") + F.lit(eps))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a/b as a double; NULL where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def epoch_year(c: Column | str) -> Column:
    """UTC calendar year of epoch seconds, whatever the session's time zone."""
    days = F.floor(col(c).cast("double") / F.lit(86400.0)).cast("int")
    return F.year(F.date_add(F.lit("1970-01-01").cast("date"), days))


def band(
    z: Column | str,
    ranges: Sequence[tuple[float, float]] = LEVEL_RANGES,
    labels: Sequence[str] = LEVELS,
    strict: bool = False,
) -> Column:
    """Label of the first closed range that holds the value.

    A missing or non-finite value has no label; with `strict` it stops the query,
    as does a value outside every range.
    """
    if len(ranges) != len(labels):
        raise ValueError("as many labels as ranges are needed")
    z = finite(z)
    outside = (
        F.raise_error(F.concat(F.lit("no range holds "), F.coalesce(z.cast("string"), F.lit("NULL"))))
        if strict else F.lit(None).cast("string")
    )
    found = None
    for (low, high), label in zip(ranges, labels):
        holds = z.between(F.lit(low), F.lit(high))
        found = F.when(holds, label) if found is None else found.when(holds, label)
    return found.otherwise(outside)


def ordinal_map(c: Column | str, codes: Mapping[str, int], strict: bool = False) -> Column:
    """Integer code of a category. NULL stays NULL; an unknown one does too,
    unless `strict`, which stops the query."""
    c = col(c)
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    for name, code in codes.items():
        out = out.when(c == name, code)
    if strict:
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown category: "), c)).cast("int"))
    return out


def flag_above(c: Column | str, threshold: float = 0.5) -> Column:
    """1 above the threshold, else 0; missing counts as 0."""
    return F.coalesce((col(c) > threshold).cast("int"), F.lit(0))


def relabel(c: Column | str, old: str, new: str) -> Column:
    c = col(c)
    return F.when(c == old, new).otherwise(c)


def mask_small(r: Column | str, threshold: float, digits: int = 3) -> Column:
    """Rounded text of a coefficient, or `-` where it is weaker than the threshold."""
    r = col(r)
    text = F.round(r, digits).cast("string")
    return F.when(F.abs(r) < threshold, "-").otherwise(text) if threshold > 0 else text


def order_slot(v: Column | str, per_octave: int = SLOTS_PER_OCTAVE) -> Column:
    """A whole number that never falls as v grows.

    Logarithmic slots, mirrored for negatives: they depend on the value alone, so
    any task can assign them, and a group of any size falls into a few thousand
    of them. Used to cut the sorting of one hot group over many tasks.
    """
    v = col(v)
    # The smallest double is 2^-1074: the offset keeps positive slots positive.
    magnitude = F.floor(F.log2(F.abs(v)) * per_octave) + F.lit(1100 * per_octave)
    return (
        F.when(v > 0, magnitude).when(v < 0, -magnitude).otherwise(F.lit(0))
    ).cast("long")
