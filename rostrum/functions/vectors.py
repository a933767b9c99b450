"""Expressions over `array<double>`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from rostrum.functions.numeric import col


def parse_vector(text: Column | str) -> Column:
    """Decode list text such as `[1.0, -2e-3]`."""
    return F.from_json(col(text), "array<double>")


def concat(*vectors: Column | str) -> Column:
    return F.concat(*[col(v) for v in vectors])


def assemble(columns: Sequence[str]) -> Column:
    """Named scalars as one vector; NULL if any of them is missing."""
    parts = F.array(*[F.col(c).cast("double") for c in columns])
    return F.when(F.forall(parts, lambda x: x.isNotNull()), parts)
