"""Reports over the target, feature and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rostrum.functions import ratings as R
from rostrum.functions.numeric import ordinal_map, ratio, relabel
from rostrum.functions.vectors import concat
from rostrum.functions.text import clean_transcript, fill_text, truncate_tokens, word_count
from rostrum.operators.correlate import corr_matrix, corr_rank, corr_table
from rostrum.operators.positions import add_appearance_code
from rostrum.operators.models import principal_components
from rostrum.operators.summaries import cohorts, histograms, tops_contain, value_counts
from rostrum.session import durable
from rostrum.vocab import (
    AGE_BANDS, COHORT_SIZE, CORRELATION_THRESHOLD, MAX_TOKENS, MODEL_COLUMNS, POPULARITY_TARGETS, RATINGS,
    SURVEY_COLUMNS,
)


def survey_columns(
    talks: DataFrame, row_key: str, names: Sequence[str] = RATINGS, strict: bool = False
) -> DataFrame:
    """Talks with the columns the correlation table looks at: rating shares, speaker
    code, words, minutes, ratios and the age code."""
    talks = add_appearance_code(talks, "main_speaker", row_key, "speaker_id")
    talks = talks.withColumns({
        **{name: R.last_share("ratings", name) for name in names},
        "transcript": fill_text("transcript"),
        "wc": word_count("transcript"),
        "duration": ratio("duration", F.lit(60)),
        "comments_views": ratio("comments", "views"),
        "views_comments": ratio("views", "comments"),
        "age": ordinal_map("age", AGE_BANDS, strict),
    })
    return talks.withColumn("wpm", ratio("wc", "duration"))


def survey_table(
    survey: DataFrame, columns: Sequence[str] = SURVEY_COLUMNS, names: Sequence[str] = RATINGS,
    threshold: float = CORRELATION_THRESHOLD,
) -> DataFrame:
    """Columns x ratings as text, weak coefficients as `-`."""
    return corr_table(survey, columns, names, threshold)


def survey_matrix(
    survey: DataFrame, columns: Sequence[str] = SURVEY_COLUMNS, names: Sequence[str] = RATINGS
) -> DataFrame:
    """Every pair of the survey's columns and ratings."""
    return corr_matrix(survey, [*names, *columns])


def cohort_correlations(
    features: DataFrame, metric: str, key: str, columns: Sequence[str] | None = None,
    n: int = COHORT_SIZE,
) -> DataFrame:
    """Features by correlation with a metric over its top and bottom talks."""
    columns = list(columns or [*MODEL_COLUMNS, "gender_male_mean"])
    chosen = features.select(key, metric, *columns)
    return corr_rank(cohorts(chosen, metric, key, n), columns, metric)


def metric_scores(scores: DataFrame, metric: str) -> DataFrame:
    return scores.where(F.col("metric") == metric).orderBy("value", "target", "type")


def score_report(
    scores: DataFrame, metric: str, types: Sequence[str], popularity: bool,
    targets: Sequence[str] = POPULARITY_TARGETS,
) -> DataFrame:
    """One metric of some feature sets, for the popularity targets or for the others."""
    named = scores.withColumn("type", relabel("type", "Embeddings", "Behavioral Embeddings"))
    inside = F.col("target").isin(*targets)
    return named.where(
        (inside if popularity else ~inside)
        & (F.col("metric") == metric) & F.col("type").isin(*types)
    ).orderBy("value", "target", "type")


def transcript_inputs(
    talks: DataFrame, key: str = "url", transcript: str = "transcript", limit: int = MAX_TOKENS
) -> DataFrame:
    """`(key, text)` for the embedding of transcripts: cleaned, those left empty skipped,
    cut to `limit` words."""
    cleaned = talks.select(key, clean_transcript(transcript).alias("clean"))
    # NULL fails the test as well.
    return cleaned.where(F.col("clean") != "").select(key, truncate_tokens("clean", limit).alias("text"))


def target_histograms(targets: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Histograms of several columns, one below the other, under `target`."""
    return histograms(targets, columns, bins).withColumnRenamed("name", "target")


def level_counts(targets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per level of several level columns, in one pass."""
    long = targets.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("target"), F.col(f"`{c}`").alias("level")) for c in columns
    ])))
    return value_counts(long, "target", "level")


def rating_tops(talks: DataFrame, names: Sequence[str] = RATINGS, ratings: str = "ratings", k: int = 5
                ) -> DataFrame:
    """For each rating, the talks with it among their k largest and those without."""
    return tops_contain(talks, ratings, names, k)


def cohort_histograms(
    features: DataFrame, metric: str, key: str, columns: Sequence[str], bins: int = 50,
    n: int = COHORT_SIZE,
) -> DataFrame:
    """Histograms of features in the top and bottom talks, over the bins of both."""
    # At most 2n rows, read for their ends and for their counts.
    ends = durable(cohorts(features.select(key, metric, *columns), metric, key, n), "ends")
    return histograms(ends, columns, bins, ["rank"]).withColumnRenamed("name", "feature")


def cohort_projection(
    features: DataFrame, metric: str, key: str, vectors: Sequence[str], k: int = 2, n: int = COHORT_SIZE
) -> DataFrame:
    """`(key, rank, pc1..pck)`: the vectors of the top and bottom talks, joined end to end,
    scaled and projected."""
    ends = cohorts(features.select(key, metric, *vectors), metric, key, n)
    return principal_components(ends.select(key, "rank", concat(*vectors).alias("x")), "x", k)
