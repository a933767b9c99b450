import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import metrics as M
from rostrum.vocab import LEVELS


def predictions(spark, pairs, run="a"):
    return spark.createDataFrame([(run, y, p) for y, p in pairs], "run string, y string, p string")


def test_confusion_keeps_zero_cells(spark):
    out = M.confusion(predictions(spark, [("low", "high"), ("low", "high"), ("high", "high")]), ["run"])
    cells = {(r["y"], r["p"]): r["n"] for r in out.collect()}
    assert len(cells) == 9 and sum(cells.values()) == 3
    assert cells["low", "high"] == 2 and cells["medium", "medium"] == 0


def test_class_and_run_scores(spark):
    pairs = [("low", "low"), ("low", "high"), ("high", "high"), ("high", "high")]
    by_class = {r["class"]: r for r in M.class_scores(predictions(spark, pairs), ["run"]).collect()}
    assert by_class["low"]["precision"] == 1.0 and by_class["low"]["recall"] == 0.5
    assert by_class["high"]["precision"] == pytest.approx(2 / 3)
    assert by_class["medium"]["f1"] == 0.0 and not by_class["medium"]["seen"]
    run = M.run_scores(predictions(spark, pairs), ["run"]).first()
    # Macro over the classes that occur only.
    assert run["f1_macro"] == pytest.approx((2 / 3 + 0.8) / 2)
    assert run["f1_weighted"] == pytest.approx((2 / 3 * 2 + 0.8 * 2) / 4)
    assert run["accuracy"] == 0.75


def test_extreme_agreement(spark):
    pairs = [("high", "high"), ("low", "high"), ("medium", "low"), ("high", "medium")]
    assert M.run_scores(predictions(spark, pairs), ["run"]).first()["extreme_errors"] == 0.5
    pairs = [("medium", "low"), ("high", "medium")]
    assert M.run_scores(predictions(spark, pairs), ["run"]).first()["extreme_errors"] == 0.0


def brute_auc(y, s):
    pos, neg = s[y], s[~y]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(6)
    y = rng.choice(LEVELS, 400)
    scores = {
        "low": np.round(rng.normal(0, 1, 400), 1), "medium": rng.random(400) * 1e-9 - 5e-10,
        "high": rng.choice([0.0, -0.0, 0.5, 1.0], 400),
    }
    rows = [("a", str(y[i]), *[float(scores[c][i]) for c in LEVELS]) for i in range(400)]
    rows += [("b", "low", 0.1, 0.2, 0.3), ("b", "high", 0.3, 0.2, 0.1)]
    df = spark.createDataFrame(rows, "run string, y string, low double, medium double, high double")
    out = {(r["run"], r["class"]): r["auc"] for r in M.class_auc(df.repartition(5), ["run"]).collect()}
    for c in LEVELS:
        assert out["a", c] == pytest.approx(brute_auc(y == c, scores[c]), abs=1e-12)
    assert out["b", "low"] == 0.0 and out["b", "medium"] is None and out["b", "high"] == 0.0
    flipped = df.select("run", "y", *[(-F.col(c)).alias(c) for c in LEVELS])
    for r in M.class_auc(flipped.where("run = 'a'"), ["run"]).collect():
        assert r["auc"] + out["a", r["class"]] == pytest.approx(1)


def test_score_table_averages_folds(spark):
    rows = [("t", f, y, p, 0.1, 0.2, 0.7) for f, y, p in [
        (0, "low", "low"), (0, "medium", "low"), (0, "high", "high"), (1, "low", "high"), (1, "high", "high"),
    ]]
    df = spark.createDataFrame(
        rows, "target string, fold int, y string, p string, low double, medium double, high double")
    out = {r["metric"]: r["value"] for r in M.score_table(df, ["target"], "fold").collect()}
    assert len(out) == 12
    assert out["precision_low"] == 0.25 and out["recall_high"] == 1.0
    assert out["auc_medium"] == 0.5 and out["auc_low"] == 0.5
    assert out["extreme_errors"] == 0.75
    # The second fold has no medium row.
    assert M.score_table(df, ["target"], "fold", strict=True).collect() == []
