"""Expressions over `array<struct<name:string,count:bigint>>`.

All are higher-order functions within the row: no explode, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from rostrum.functions.numeric import col, ratio
from rostrum.vocab import NEGATIVE_RATINGS, POSITIVE_RATINGS, RATINGS

RATINGS_TYPE = "array<struct<name:string,count:bigint>>"


def parse_ratings(text: Column | str) -> Column:
    """Decode list-of-dict text; single quotes are accepted, extra keys dropped."""
    return F.from_json(col(text), RATINGS_TYPE)


def total(ratings: Column | str) -> Column:
    return F.aggregate(col(ratings), F.lit(0).cast("long"), lambda acc, r: acc + r["count"])


def named_total(ratings: Column | str, names: Iterable[str]) -> Column:
    """Sum of the counts whose name is in `names`."""
    chosen = list(names)
    return total(F.filter(col(ratings), lambda r: r["name"].isin(chosen)))


def share(ratings: Column | str, name: str) -> Column:
    """Share of the first entry of that name; NULL if there is none."""
    ratings = col(ratings)
    first = F.get(F.filter(ratings, lambda r: r["name"] == name), F.lit(0))
    return ratio(first["count"], total(ratings))


def last_share(ratings: Column | str, name: str) -> Column:
    """As `share`, but a repeated name counts with its last entry."""
    ratings = col(ratings)
    mine = F.filter(ratings, lambda r: r["name"] == name)
    return ratio(F.get(mine, F.size(mine) - 1)["count"], total(ratings))


def wide_shares(ratings: Column | str, names: Sequence[str] = RATINGS) -> list[Column]:
    """One share column per name."""
    return [last_share(ratings, name).alias(name) for name in names]


def sentiment(
    ratings: Column | str,
    positive: Sequence[str] = POSITIVE_RATINGS,
    negative: Sequence[str] = NEGATIVE_RATINGS,
) -> Column:
    """(pos - neg) / (pos + neg), between -1 and 1; NULL without any of them."""
    pos, neg = named_total(ratings, positive), named_total(ratings, negative)
    return ratio(pos - neg, pos + neg)


def top_names(ratings: Column | str, k: int) -> Column:
    """Names of the k largest counts; equal counts keep their list order."""
    keyed = F.transform(
        col(ratings),
        lambda r, i: F.struct((-r["count"]).alias("a"), i.alias("b"), r["name"].alias("name")),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda r: r["name"])
