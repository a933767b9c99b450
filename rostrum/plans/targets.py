"""Popularity and rating targets of every talk."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, functions as F

from rostrum.functions import ratings as R
from rostrum.functions.numeric import band, epoch_year, log, log_offset, ratio
from rostrum.functions.text import fill_text
from rostrum.operators.zscore import zscore
from rostrum.vocab import NEGATIVE_RATINGS, POSITIVE_RATINGS, YEARS


def with_years(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "film_year": epoch_year("film_date"),
        "published_year": epoch_year("published_date"),
    })


def select_talks(df: DataFrame, years: tuple[int, int] = YEARS, speakers: int = 1,
                 counted: Observation | None = None) -> DataFrame:
    """Talks filmed in the years given (UTC), by that many speakers. The test is on the raw
    epoch column, so that it reaches the scan.

    `counted` tells, once a job has run on the result, how many talks were read, selected, and
    left out for their year, else for their speakers. It has to see the talks left out, so the
    scan then reads them.
    """
    first, last = (
        int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (years[0], years[1] + 1)
    )
    in_years = (F.col("film_date") >= first) & (F.col("film_date") < last)
    by_few = F.col("num_speaker") == speakers
    if counted is not None:
        inside, few = (F.coalesce(c, F.lit(False)) for c in (in_years, by_few))
        df = df.observe(
            counted, F.count(F.lit(1)).alias("read"), F.count_if(inside & few).alias("selected"),
            F.count_if(~inside).alias("other_year"), F.count_if(inside & ~few).alias("other_speakers"),
        )
    return df.where(in_years & by_few)


def popularity_columns(df: DataFrame) -> DataFrame:
    """Add the popularity measures that need no rating names."""
    return df.withColumns({
        "log_views": log("views"),
        "log_comments": log("comments"),
        "comments_per_view": ratio("comments", "views"),
        "log_comments_per_view": log(ratio("comments", "views")),
    })


def rating_targets(
    df: DataFrame,
    positive: Sequence[str] = POSITIVE_RATINGS,
    negative: Sequence[str] = NEGATIVE_RATINGS,
    strict: bool = False,
) -> DataFrame:
    """Add all target columns to talks with `views`, `comments` and `ratings`.

    All measures are computed first, then all z-scores in one aggregate.
    """
    names = [*positive, *negative]
    # Rating sums and shares form their own projection, for they are used often below.
    df = popularity_columns(df).withColumns({
        "ratings_sum": R.total("ratings"),
        "sentiment": R.sentiment("ratings", positive, negative),
        "negative_ratings": R.named_total("ratings", negative),
        **{name: R.share("ratings", name) for name in names},
    })
    df = df.withColumns({
        "log_ratings_views": log(ratio("ratings_sum", "views")),
        "log_negative_ratings": log_offset("negative_ratings"),
        **{f"log_{n}": log_offset(f"`{n}`") for n in names},
        **{f"{n}_views": F.col(f"`{n}`") * F.col("log_views") for n in names},
    })
    df = df.withColumns({f"log_{n}_views": log_offset(f"`{n}_views`") for n in names})
    logs = [
        "log_views", "log_comments", "log_comments_per_view", "log_ratings_views",
        "log_negative_ratings",
        *[f"log_{n}" for n in names], *[f"log_{n}_views" for n in names],
    ]
    df = zscore(df, ["views", "comments", "comments_per_view", *logs])
    return df.withColumns({
        f"{c}_norm_cat": band(f"`{c}_norm`", strict=strict) for c in logs
    })


def popularity_targets(
    talks: DataFrame, strict: bool = False, counted: Observation | None = None
) -> DataFrame:
    """Talk table to target table: years, selection, measures, levels."""
    df = select_talks(with_years(talks), counted=counted)
    df = df.withColumn("speaker_occupation", fill_text("speaker_occupation"))
    return rating_targets(df, strict=strict)
