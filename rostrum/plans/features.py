"""The feature table: utterance statistics, vectors and MFCCs per talk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, functions as F

from rostrum.functions.numeric import flag_above
from rostrum.functions.vectors import assemble, concat
from rostrum.operators.order_stats import describe
from rostrum.operators.summaries import drop_incomplete, join_on_text
from rostrum.operators.utterances import (
    label_value, label_values, pauses, turn_durations, utterances,
)
from rostrum.operators.vector_stats import weighted_vector_stats
from rostrum.session import durable
from rostrum.vocab import GAPS, MODEL_COLUMNS, TASKS

STATS = {"mean": "mean", "90p": "p90", "std": "std", "10p": "p10"}


def measure_columns(tasks: Mapping[str, Sequence[str]] = TASKS) -> dict[str, tuple[str, str]]:
    """Feature name to (measure, statistic), by rule."""
    labels = [f"{task}_{label}" for task, names in tasks.items() for label in names]
    wanted = [(m, s) for m in labels for s in ("mean", "90p", "std")]
    wanted += [(m, s) for m in GAPS for s in ("mean", "std", "10p", "90p")]
    return {f"{m}_{s}": (m, STATS[s]) for m, s in wanted}


def pivot_measures(
    stats: DataFrame, key: str, tasks: Mapping[str, Sequence[str]] = TASKS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key from `(key, measure, statistics...)`; the names are known, so
    no job has to look for them."""
    named = measure_columns(tasks)
    return stats.groupBy(key).agg(*[
        F.max(F.when(F.col("measure") == m, F.col(s))).alias(name)
        for name, (m, s) in named.items() if columns is None or name in columns
    ])


def problems(utts: DataFrame, key: str, tasks: Mapping[str, Sequence[str]] = TASKS) -> DataFrame:
    """`(key, reason)` of the talks whose utterances cannot be summarised."""
    no_number = reduce(or_, [
        label_value(task, label).isNotNull() & label_value(task, label)["posterior"].isNull()
        for task, names in tasks.items() for label in names
    ])
    # The last prediction of a known task has no list.
    no_list = reduce(or_, [F.col(f"{task}_bare") for task in tasks])
    no_document = F.col("id").isNull() & F.col("ord").isNull()
    bad = F.col("bad") | F.col("id").isNull() | F.col("st").isNull() | F.col("et").isNull()
    with_vector = F.size("vector") > 0
    checks = utts.groupBy(key).agg(
        F.max(F.coalesce(bad, F.lit(False)) | F.coalesce(no_number, F.lit(False))).alias("bad"),
        F.max(no_document).alias("no_document"),
        F.max(F.coalesce(no_list, F.lit(False))).alias("no_list"),
        F.count("*").alias("n"),
        F.sum(F.when(with_vector, F.col("et") - F.col("st"))).alias("weight"),
        F.min(F.size("vector")).alias("narrow"), F.max(F.size("vector")).alias("wide"),
    )
    return checks.select(
        key,
        F.when(F.col("no_document"), "bad_document")
        .when(F.col("no_list"), "bad_prediction")
        .when(F.col("bad"), "bad_number")
        .when(F.col("n") < 2, "lt2_utterances")
        .when(F.col("weight").isNull() | (F.col("weight") == 0), "no_embedding")
        .when(F.col("narrow") != F.col("wide"), "uneven_embedding").alias("reason"),
    ).where(F.col("reason").isNotNull())


def talk_features(
    predictions: DataFrame, key: str = "filename", tasks: Mapping[str, Sequence[str]] = TASKS
) -> tuple[DataFrame, DataFrame]:
    """Features per talk, and the talks left out with the reason.

    The utterance table feeds five readers below, so it is written once.
    """
    utts = durable(utterances(predictions, key, tasks))
    excluded = problems(utts, key, tasks)
    measures = (
        label_values(utts, key, tasks)
        .unionByName(turn_durations(utts, key))
        .unionByName(pauses(utts, key))
    )
    scalars = pivot_measures(describe(measures, [key, "measure"], "value"), key, tasks)
    vectors = weighted_vector_stats(
        utts.withColumn("weight", F.col("et") - F.col("st")), [key], "vector", "weight"
    ).select(
        key, F.col("vec_mean").alias("features_embedding_mean"),
        F.col("vec_std").alias("features_embedding_std"),
    )
    # Overlapping turns weigh less than nothing; their deviation may not exist.
    undefined = vectors.where(
        F.exists("features_embedding_std", lambda x: x.isNull())
        | F.exists("features_embedding_mean", lambda x: x.isNull())
    ).join(excluded, key, "left_anti").select(key, F.lit("undefined_deviation").alias("reason"))
    excluded = durable(excluded.unionByName(undefined), "excluded")
    features = scalars.join(vectors, key).join(excluded.select(key), key, "left_anti")
    return features, excluded


def feature_table(
    talks: DataFrame, features: DataFrame, excluded: DataFrame, mfcc: DataFrame,
    key: str = "filename",
) -> tuple[DataFrame, DataFrame]:
    """Talks with all their features, and `(key, reason)` of the others."""
    table = talks.join(features, key).join(mfcc, key)
    out = (
        talks.select(key).distinct()
        .join(features.select(key, F.lit(True).alias("_has")), key, "left")
        .join(mfcc.select(key, F.lit(True).alias("_mfcc")).distinct(), key, "left")
        .join(excluded, key, "left")
        .select(key, F.coalesce(
            "reason",
            F.when(F.col("_has").isNull(), "no_result").when(F.col("_mfcc").isNull(), "no_mfcc"),
        ).alias("reason"))
        .where(F.col("reason").isNotNull())
    )
    return table, out


def model_table(
    features: DataFrame, text_embeddings: DataFrame, targets: Sequence[str], key: str = "url",
    null_as_text: bool = False, csv_parity: bool = False,
) -> DataFrame:
    """Complete talks with the five base vectors of the experiment and the targets."""
    joined = drop_incomplete(
        join_on_text(features, text_embeddings, key, null_as_text), csv_parity=csv_parity
    )
    # A vector with a gap, or not as wide as the others, cannot be scaled.
    vectors = ("features_embedding_mean", "features_embedding_std", "mfccs_mean", "mfccs_std", "embeddings")
    widths = joined.agg(F.struct(*[F.mode(F.size(v), True).alias(v) for v in vectors])).scalar()
    joined = joined.withColumn("_widths", widths).where(reduce(and_, [
        (F.size(v) == F.col("_widths")[v]) & ~F.exists(v, lambda x: x.isNull()) for v in vectors
    ]))
    return joined.select(
        key, *[f"`{t}`" for t in targets],
        concat("features_embedding_mean", "features_embedding_std").alias("x_embedding"),
        assemble(MODEL_COLUMNS).alias("x_posterior"),
        concat("mfccs_mean", "mfccs_std").alias("x_mfcc"),
        F.array(flag_above("gender_male_mean").cast("double")).alias("x_gender"),
        F.col("embeddings").alias("x_text"),
    )
