"""From predictions to utterances, and from utterances to measures.

Input rows are predictions `(key, pos, id, st, et, task, prediction, vector, bad)`
as `rostrum.sources.results` gives them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rostrum.vocab import EMBEDDING_TASK, TASKS

SLICE = 1 << 20


def utterances(
    predictions: DataFrame, key: str, tasks: Mapping[str, Sequence[str]] = TASKS
) -> DataFrame:
    """One row per utterance: `ord`, `st`, `et`, one prediction list per task, `vector`.

    The first prediction of an id sets its times, the last one of each task counts.
    All of it is one aggregation by (key, id), so a long talk spreads over tasks.
    """
    def last(column: str, task: str) -> Column:
        mine = F.col("task") == task
        return F.max_by(F.when(mine, F.col(column)), F.when(mine, F.col("pos")))

    out = predictions.groupBy(key, "id").agg(
        F.min("pos").alias("ord"),
        F.min_by(F.struct("st", "et"), "pos").alias("span"),
        *[last("prediction", task).alias(task) for task in tasks],
        *[_last_bare(task).alias(f"{task}_bare") for task in tasks],
        last("vector", EMBEDDING_TASK).alias("vector"),
        F.max("bad").alias("bad"),
    )
    return out.select(key, "id", "ord", "span.st", "span.et", *tasks,
                      *[f"{t}_bare" for t in tasks], "vector", "bad")


def _last_bare(task: str) -> Column:
    """Whether the last prediction of a task comes without a list."""
    mine = F.col("task") == task
    return F.max_by(F.when(mine, F.col("prediction").isNull()), F.when(mine, F.col("pos")))


def label_value(task: str, label: str) -> Column:
    """(present, value) of a label; a label listed twice counts with its last value."""
    mine = F.filter(task, lambda x: x["label"] == label)
    return F.get(mine, F.size(mine) - 1)


def label_values(
    utts: DataFrame, key: str, tasks: Mapping[str, Sequence[str]] = TASKS
) -> DataFrame:
    """Long form `(key, measure, value)` of the known labels that are present."""
    items = F.array(*[
        F.struct(
            F.lit(f"{task}_{label}").alias("measure"),
            label_value(task, label).alias("entry"),
        )
        for task, labels in tasks.items() for label in labels
    ])
    return (
        utts.select(key, F.explode(items).alias("x")).where(F.col("x.entry").isNotNull())
        .select(key, "x.measure", F.col("x.entry.posterior").alias("value"))
    )


def turn_durations(utts: DataFrame, key: str) -> DataFrame:
    return utts.select(
        key, F.lit("turn_durations").alias("measure"), (F.col("et") - F.col("st")).alias("value")
    )


def pauses(utts: DataFrame, key: str, width: int = SLICE) -> DataFrame:
    """Gap to the previous utterance's end, in order of `ord`; overlaps are negative.

    `ord` is a whole number, unique within the key. It is cut into slices of
    `width` places, so a window never holds more than that many rows, and the gaps
    between neighbouring slices come from one row of first and last utterances each.
    """
    sliced = utts.select(key, "ord", "st", "et", F.floor(F.col("ord") / width).alias("slice"))
    within = W.partitionBy(key, "slice").orderBy("ord")
    inner = sliced.select(
        key, F.row_number().over(within).alias("place"),
        (F.col("st") - F.lag("et").over(within)).alias("value"),
    ).where(F.col("place") > 1)
    edges = sliced.groupBy(key, "slice").agg(
        F.min_by("st", "ord").alias("first_st"), F.max_by("et", "ord").alias("last_et")
    )
    across = W.partitionBy(key).orderBy("slice")
    outer = edges.select(
        key, F.row_number().over(across).alias("place"),
        (F.col("first_st") - F.lag("last_et").over(across)).alias("value"),
    ).where(F.col("place") > 1)
    return inner.unionByName(outer).select(key, F.lit("pauses").alias("measure"), "value")
