"""Classification metrics of many runs at once.

Input rows are predictions `(run columns..., y, p)`. One aggregation to
(run, y, p) counts serves everything but the AUC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rostrum.functions.numeric import finite, order_slot
from rostrum.operators.order_stats import equal_part, same_key
from rostrum.session import durable
from rostrum.vocab import LEVELS


def outcome_counts(predictions: DataFrame, run: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*run, "y", "p").agg(F.count("*").alias("n"))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def confusion(
    predictions: DataFrame, run: Sequence[str], labels: Sequence[str] = LEVELS
) -> DataFrame:
    """Every cell of the label x label table of each run, zeros included."""
    cells = [(y, p) for y in labels for p in labels]
    wide = outcome_counts(predictions, run).groupBy(*run).agg(*[
        _count((F.col("y") == y) & (F.col("p") == p)).alias(f"n{k}")
        for k, (y, p) in enumerate(cells)
    ])
    return wide.select(*run, F.inline(F.array(*[
        F.struct(F.lit(y).alias("y"), F.lit(p).alias("p"), F.col(f"n{k}").alias("n"))
        for k, (y, p) in enumerate(cells)
    ])))


def class_scores(
    predictions: DataFrame, run: Sequence[str], labels: Sequence[str] = LEVELS
) -> DataFrame:
    """Per run and class: precision, recall, F1 (0 where undefined), support, and
    whether the class occurs in truth or prediction."""
    y, p = F.col("y"), F.col("p")
    wide = outcome_counts(predictions, run).groupBy(*run).agg(*[
        _count(condition).alias(f"{name}{k}")
        for k, label in enumerate(labels)
        for name, condition in (
            ("hit", (y == label) & (p == label)), ("true", y == label), ("said", p == label),
        )
    ])
    long = wide.select(*run, F.inline(F.array(*[
        F.struct(
            F.lit(label).alias("class"), F.col(f"hit{k}").alias("hit"),
            F.col(f"true{k}").alias("support"), F.col(f"said{k}").alias("said"),
        )
        for k, label in enumerate(labels)
    ])))
    hit = F.col("hit").cast("double")
    zero = F.lit(0.0)
    return long.select(
        *run, "class",
        F.coalesce(F.try_divide(hit, F.col("said")), zero).alias("precision"),
        F.coalesce(F.try_divide(hit, F.col("support")), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * hit, F.col("said") + F.col("support")), zero).alias("f1"),
        "support",
        (F.col("support") + F.col("said") > 0).alias("seen"),
    )


def run_scores(
    predictions: DataFrame, run: Sequence[str], middle: str = LEVELS[1]
) -> DataFrame:
    """Per run: accuracy, macro and weighted F1, and `extreme_errors`.

    The last is the accuracy over rows where neither truth nor prediction is the
    middle class (0 without such rows): higher is better, whatever its name says.
    """
    counts = outcome_counts(predictions, run)
    y, p, n = F.col("y"), F.col("p"), F.col("n")
    # Each count gives its rows to the truth's class and to the prediction's class.
    sides = counts.select(*run, F.inline(F.array(
        F.struct(y.alias("class"), n.alias("true"), F.lit(0).cast("bigint").alias("said"),
                 F.when(y == p, n).otherwise(0).alias("hit")),
        F.struct(p.alias("class"), F.lit(0).cast("bigint").alias("true"), n.alias("said"),
                 F.lit(0).cast("bigint").alias("hit")),
    )))
    by_class = sides.groupBy(*run, "class").agg(
        F.sum("true").alias("true"), F.sum("said").alias("said"), F.sum("hit").alias("hit")
    ).withColumn("f1", 2.0 * F.col("hit") / (F.col("true") + F.col("said")))
    f1 = by_class.groupBy(*run).agg(
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("true")) / F.sum("true")).alias("f1_weighted"),
        (F.sum("hit") / F.sum("true")).alias("accuracy"),
    )
    far = (y != middle) & (p != middle)
    extreme = counts.groupBy(*run).agg(F.coalesce(
        F.try_divide(_count(far & (y == p)).cast("double"), _count(far)), F.lit(0.0)
    ).alias("extreme_errors"))
    return f1.join(extreme, list(run))


def class_auc(
    scored: DataFrame, run: Sequence[str], labels: Sequence[str] = LEVELS
) -> DataFrame:
    """One-against-rest area under the ROC curve per run and class.

    `scored` has `y` and one score column per label, named as the label. Rows are
    first counted per distinct score (ties count half), the scores of a run are
    cut into order slots and these into equal parts, and parts and slots are chained
    by their counts: a run of any size is ranked over many tasks. NULL where a class has no or only positives.
    """
    keys = [*run, "class"]
    long = scored.select(*run, "y", F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), finite(f"`{c}`").alias("score"))
        for c in labels
    ])))
    is_class = F.col("y") == F.col("class")
    scores = durable(long.groupBy(*keys, order_slot("score").alias("slot"), "score").agg(
        F.count(F.when(is_class, 1)).alias("pos"),
        F.count(F.when(~is_class, 1)).alias("neg"),
    ), "scores")
    # A slot's scores are cut again between its own ends, however close those are.
    ends = scores.groupBy(*keys, "slot").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    cut = scores.join(
        ends.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "slot"]], "lo", "hi"),
        [same_key(k) for k in [*keys, "slot"]],
    ).select(*keys, "slot", equal_part("score", "lo", "hi").alias("part"), "score", "pos", "neg",
             (F.col("pos") * F.col("neg") / 2).alias("area"))
    for order in ("score", "part", "slot"):
        inner = [*keys, *[k for k in ("slot", "part") if order == "score" or (k, order) == ("slot", "part")]]
        before = W.partitionBy(*inner).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        cut = cut.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0))).groupBy(*inner).agg(
            F.sum(F.col("area") + F.col("pos") * F.col("below")).alias("area"),
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        )
    return cut.select(*keys, F.try_divide(
        F.col("area"), F.col("pos").cast("double") * F.col("neg")
    ).alias("auc"))


def score_table(
    scored: DataFrame, run: Sequence[str], fold: str, labels: Sequence[str] = LEVELS,
    middle: str = LEVELS[1], strict: bool = False,
) -> DataFrame:
    """Long score rows `(run..., metric, value)`, averaged over folds.

    With `strict`, a run that lacks an AUC in any fold is left out altogether.
    """
    each = [*run, fold]
    per_class = class_scores(scored, each, labels).join(
        class_auc(scored, each, labels), [*each, "class"], "left"
    )
    long = per_class.unpivot(
        [*each, "class"], ["precision", "recall", "auc"], "kind", "value"
    ).select(*each, F.concat_ws("_", "kind", "class").alias("metric"), "value")
    overall = run_scores(scored, each, middle).unpivot(
        each, ["f1_macro", "f1_weighted", "extreme_errors"], "metric", "value"
    )
    rows = long.unionByName(overall)
    if strict:
        broken = rows.where(F.col("value").isNull()).select(*run).distinct()
        rows = rows.join(broken, list(run), "left_anti")
    return rows.groupBy(*run, "metric").agg(F.avg("value").alias("value"))
