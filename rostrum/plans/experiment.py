"""Cross-validated experiments over targets and feature sets."""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import quote

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.functions.vectors import concat
from rostrum.operators import models
from rostrum.operators.kernel_ridge import kernel_ridge
from rostrum.operators.metrics import confusion, run_scores, score_table
from rostrum.operators.positions import balanced_folds, hash_folds, holdout
from rostrum.session import durable, file_system, landing, until_exit
from rostrum.vocab import FOLDS, LEVELS

# Names of the feature sets, the vectors each is made of, and the
# kind of model it gets.
FEATURE_SETS = {
    "Embeddings": ("x_embedding",),
    "Posteriors": ("x_posterior",),
    "Gender": ("x_gender",),
    "Posteriors+gender": ("x_posterior", "x_gender"),
    "MFCC": ("x_mfcc",),
    "Text": ("x_text",),
    "Audio-Text": ("x_embedding", "x_text"),
    "Baseline": ("x_embedding",),
}
KERNEL_MACHINES = {"svc": models.kernel_svc, "ridge": kernel_ridge}
KERNEL_SETS = ("Embeddings", "MFCC", "Text", "Audio-Text")
BASELINE_SET = "Baseline"


def predict(
    train: DataFrame, test: DataFrame, kind: str, labels: Sequence[str], scale: bool = True,
    **options
) -> DataFrame:
    """Fit, and predict the test rows. Tables: key, y, x. Vectors are scaled by the training
    rows, or stay as they are; the kernel's width then follows their variance. The option
    `machine="ridge"` takes the kernel machine for many landmarks."""
    if scale:
        (train, test), varying = models.standardise(train, [test])
        width = 1.0 / max(varying, 1)
    else:
        width = models.scale_width(train) if kind == "kernel" else None
        train, test = (t.withColumn("x", array_to_vector("x")) for t in (train, test))
    if kind == "kernel":
        fit = KERNEL_MACHINES[options.pop("machine", "svc")]
        return fit(train, test, labels, width, **options)
    return models.forest(train, test, labels, **options)


def fold_predictions(
    table: DataFrame, kind: str, vectors: Sequence[str], labels: Sequence[str], fold: int,
    **options,
) -> DataFrame:
    """Fit on all folds but one and predict that one. `table`: key, y, fold, vectors."""
    rows = table.select("key", "y", "fold", concat(*vectors).alias("x"))
    train = rows.where(F.col("fold") != fold)
    test = rows.where(F.col("fold") == fold)
    return predict(train, test, kind, labels, **options).withColumn(
        "fold", F.lit(fold).cast("bigint")
    )


def run_predictions(
    table: DataFrame, name: str, vectors: Sequence[str], labels: Sequence[str], fold: int | None,
    folds: int = FOLDS, options: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Predictions of one feature set for one fold, or for all (`None`)."""
    if name == BASELINE_SET:
        drawn = models.stratified_baseline(table, labels)
        return drawn if fold is None else drawn.where(F.col("fold") == fold)
    kind = "kernel" if name in KERNEL_SETS else "forest"
    extra = dict((options or {}).get(kind, {}))
    wanted = range(folds) if fold is None else [fold]
    return reduce(DataFrame.unionByName, [
        fold_predictions(table, kind, vectors, labels, k, **extra) for k in wanted
    ])


def grid_signature(table: DataFrame, settings: Mapping) -> str:
    """A name for the rows and settings of a grid: equal for equal rows in any order."""
    rows = table.agg(F.count("*").alias("n"), F.sum(
        F.xxhash64(*[F.col(f"`{c}`") for c in table.columns]).cast("decimal(38,0)")
    ).alias("sum")).first()
    told = json.dumps([rows["n"], str(rows["sum"]), settings], sort_keys=True, default=str)
    return hashlib.md5(told.encode()).hexdigest()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """`(signature, target, type, fold, n)`: the finished folds of the grids kept at `path`."""
    return spark.read.parquet(f"{path.rstrip('/')}/*/*").groupBy(
        "signature", "target", "type", "fold"
    ).agg(F.count("*").alias("n"))


Unit = tuple[str, str, int | None]  # target, feature set, fold (None: all folds at once)


class _Units:
    """Finished parts of a grid: a folder of predictions each, which counts once it is committed."""

    def __init__(self, spark: SparkSession, keep: str, signature: str):
        self.spark, self.signature = spark, signature
        self.path = f"{keep.rstrip('/')}/{signature}"

    def folder(self, unit: Unit) -> str:
        # Names of any letters, without those that paths and patterns give a meaning.
        return f"{self.path}/{'-'.join(quote(str(part), safe='').replace('%', '_') for part in unit)}"

    def finished(self) -> set[str]:
        """The folders of committed units, by one listing."""
        system, where = file_system(self.spark, f"{self.path}/*/_SUCCESS")
        found = system.globStatus(where) or []
        return {f.getPath().getParent().getName() for f in found}

    def lacks(self, unit: Unit, finished: set[str]) -> bool:
        return self.folder(unit).rpartition("/")[2] not in finished

    def write(self, unit: Unit, rows: DataFrame) -> None:
        rows.select(
            F.lit(self.signature).alias("signature"), F.lit(unit[0]).alias("target"), F.lit(unit[1]).alias("type"), "*"
        ).write.mode("overwrite").parquet(self.folder(unit))


def _within(spark: SparkSession, seconds: float | None, tag: str, work: Callable[[], None]) -> None:
    """Do `work` on this thread; its Spark jobs carry `tag` and are cancelled after `seconds`."""
    context, over = spark.sparkContext, threading.Event()
    late = threading.Event()

    def watch() -> None:
        if not over.wait(seconds):
            late.set()
            # Jobs that the run submits later are cancelled as well.
            while not over.wait(0.2):
                context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    if seconds is not None:
        watcher.start()
    try:
        work()
    except Exception as problem:
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds} seconds") from problem
        raise
    finally:
        over.set()
        if seconds is not None:
            watcher.join()  # a late call must not reach the thread's next run
        context.removeJobTag(tag)


def cross_validate(
    table: DataFrame, key: str, targets: Mapping[str, str],
    feature_sets: Mapping[str, Sequence[str]] = FEATURE_SETS, labels: Sequence[str] = LEVELS,
    folds: int = FOLDS, threads: int = 4, options: Mapping[str, Mapping] | None = None,
    balanced: bool = False, keep: str | None = None, limit: float | None = None, whole: bool = False,
) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Predictions of every (target, feature set), and the runs that failed; with `whole`, a
    failed run is an error once the others have ended.

    `targets` maps a target's name to its level column. The table with its folds is
    written once and read by every fit. Each fold of each run is written on its own; `keep`
    names a folder where they stay, and a grid that is run again with the same rows and
    settings only fits what is not there. A failed run leaves the others alone, and so does one
    of whose folds takes more than `limit` seconds: its jobs are cancelled. Threads only
    hand jobs to Spark, so the fits of different runs fill the cluster together; with
    `spark.scheduler.mode=FAIR` each target is a pool. `balanced` folds differ by one row at most.
    """
    needed = sorted({v for vs in feature_sets.values() for v in vs})
    deal = balanced_folds if balanced else hash_folds
    spark = table.sparkSession
    table = durable(deal(
        table.select(F.col(key).alias("key"), *[f"`{c}`" for c in targets.values()], *needed),
        "key", folds,
    ))
    settings = {"targets": dict(targets), "sets": dict(feature_sets), "labels": list(labels),
                "folds": folds, "options": options or {}}
    own = keep is None
    keep = keep or landing(spark, "grid")
    units = _Units(spark, keep, grid_signature(table, settings))
    finished = units.finished()

    def run(target: str, name: str, fold: int | None) -> None:
        rows = table.withColumnRenamed(targets[target], "y").where(F.col("y").isNotNull())

        def work() -> None:
            out = run_predictions(rows, name, feature_sets[name], labels, fold, folds, options)
            units.write((target, name, fold), out.select(
                "key", F.col("fold").cast("bigint").alias("fold"), "y", "p", *labels))

        spark.sparkContext.setLocalProperty("spark.scheduler.pool", target)
        _within(spark, limit, f"rostrum-{uuid.uuid4().hex}", work)

    # The baseline draws all folds in one pass.
    jobs = [(target, name, fold) for target in targets for name in feature_sets
            for fold in ([None] if name == BASELINE_SET else range(folds))]
    failed: dict[tuple[str, str], str] = {}
    with ThreadPoolExecutor(threads) as pool:
        pending = [(unit, pool.submit(inheritable_thread_target(spark)(run), *unit))
                   for unit in jobs if units.lacks(unit, finished)]
        for (target, name, _), future in pending:
            try:
                future.result()
            except Exception as problem:  # the grid goes on without this run
                said = str(problem).splitlines() or [type(problem).__name__]
                failed.setdefault((target, name), said[0])
    if own and units.finished():
        until_exit(spark, keep)
    done = [units.folder(unit) for unit in jobs if unit[:2] not in failed]
    if not done:
        raise RuntimeError(f"every run failed: {failed}")
    if whole and failed:
        raise RuntimeError(f"runs failed: {failed}")
    schema = "target string, type string, key {}, fold bigint, y string, p string, {}".format(
        table.schema["key"].dataType.simpleString(), ", ".join(f"`{label}` double" for label in labels)
    )
    return spark.read.schema(schema).parquet(*done), [(*run, said) for run, said in failed.items()]


def experiment(
    table: DataFrame, key: str, targets: Mapping[str, str], strict: bool = False, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long score table of the whole grid, the first fold's confusion tables, and
    `(target, type, error)` of failed runs."""
    predictions, failed = cross_validate(table, key, targets, **options)
    labels = options.get("labels", LEVELS)
    scores = score_table(predictions, ["target", "type"], "fold", labels, strict=strict)
    errors = table.sparkSession.createDataFrame(
        failed, "target string, type string, error string"
    )
    first = confusion(predictions.where(F.col("fold") == 0), ["target", "type"], labels)
    return scores, first, errors


def holdout_predictions(
    table: DataFrame, key: str, target: str, vectors: Sequence[str], kind: str,
    labels: Sequence[str] = LEVELS, **options,
) -> DataFrame:
    """Fit once on an 80 % split of the unscaled vectors and predict the rest:
    `(target, key, y, p, scores)`."""
    rows = durable(holdout(
        table.where(F.col(target).isNotNull()).select(
            F.col(key).alias("key"), F.col(target).alias("y"), concat(*vectors).alias("x")
        ), "key",
    ))
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    return predict(train, test, kind, labels, scale=False, **options).withColumn(
        "target", F.lit(target)
    )


def holdout_run(*args, **options) -> tuple[DataFrame, DataFrame]:
    """Accuracy and F1 of `holdout_predictions`, one row, and its confusion table."""
    predictions = durable(holdout_predictions(*args, **options))
    return run_scores(predictions, ["target"]), confusion(predictions, ["target"])
