"""From files to scores: every step of the whole job on a small set of talks."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rostrum.plans import analysis
from rostrum.plans.experiment import FEATURE_SETS, experiment
from rostrum.plans.features import feature_table, model_table, talk_features
from rostrum.plans.targets import popularity_targets, rating_targets
from rostrum.sources import tables
from rostrum.sources.results import read_results
from rostrum.vocab import LOG_OFFSET, MODEL_COLUMNS, RATINGS, TARGETS, TASKS

N = 60


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    rng = np.random.default_rng(9)
    home = tmp_path_factory.mktemp("world")
    (home / "results").mkdir()
    talks = []
    for i in range(N):
        ratings = [{"id": k, "name": n, "count": int(rng.integers(1, 500))} for k, n in enumerate(RATINGS)]
        talks.append({
            "url": f"https://talks/{i}\n" if i % 2 else f"https://talks/{i}", "filename": f"talk{i}",
            "main_speaker": f"Speaker {i % 7}", "speaker_occupation": None if i % 5 == 0 else "Writer, \"poet\"",
            "num_speaker": 2 if i == 1 else 1, "film_date": 1136073600 if i == 0 else 1325376000 + i * 86400,
            "published_date": 1330000000, "views": int(rng.integers(1000, 10 ** 6)),
            "comments": int(rng.integers(1, 900)), "duration": int(rng.integers(120, 1200)),
            "languages": int(rng.integers(1, 40)), "transcript": f"Hello\nworld (Laughter) {i}" if i % 6 else None,
            "ratings": str(ratings),
        })
        items = []
        for u in range(4):
            times = {"id": u, "startTime": str(u * 10.0), "endTime": str(u * 10 + 3 + float(rng.random()))}
            for task, labels in TASKS.items():
                items.append({**times, "task": task, "prediction": [
                    {"label": x, "posterior": float(rng.random())} for x in labels]})
            items.append({**times, "task": "features", "prediction": [],
                          "embedding": str(rng.normal(0, 1, 3).tolist())})
        if i != 2:
            (home / "results" / f"talk{i}.json").write_text(json.dumps({"a": items if i != 3 else items[:5]}))
    frame = pd.DataFrame(talks)
    frame.to_csv(home / "talks.csv", index=False)
    pd.DataFrame({
        "Unnamed": range(N), "url": frame["url"].str.strip() + " ",
        "embeddings": [None if i == 4 else str(rng.normal(0, 1, 4).tolist()) for i in range(N)],
    }).to_csv(home / "embeddings.csv", index=False)
    pd.DataFrame({
        "filename": frame["filename"], "mfccs_mean": rng.normal(0, 1, (N, 2)).tolist(),
        "mfccs_std": rng.random((N, 2)).tolist(),
    })[lambda d: d["filename"] != "talk5"].to_parquet(home / "mfcc.parquet")
    return home, frame


def test_read_talks(spark, world):
    home, frame = world
    talks = tables.read_talks(spark, str(home / "talks.csv")).orderBy(F.col("film_date")).collect()
    assert len(talks) == N
    assert sum(t["speaker_occupation"] is None for t in talks) == 12
    assert {t["speaker_occupation"] for t in talks} == {None, "Writer, \"poet\""}
    assert talks[1]["url"] == "https://talks/1\n" and talks[1]["transcript"] == "Hello\nworld (Laughter) 1"
    assert len(talks[0]["ratings"]) == 14


def test_targets_equal_pandas(spark, world):
    home, frame = world
    out = popularity_targets(tables.read_talks(spark, str(home / "talks.csv")))
    chosen = frame.iloc[2:].reset_index(drop=True)
    found = out.orderBy("film_date").toPandas()
    assert len(found) == N - 2
    assert (found["speaker_occupation"] == "").sum() == 11

    def z(s):
        return (s - s.mean()) / s.std()

    def level(s):
        return np.where(s <= -1, "low", np.where(s <= 1, "medium", "high"))

    counts = chosen["ratings"].apply(lambda t: {r["name"]: r["count"] for r in eval(t)})
    total = counts.apply(lambda d: sum(d.values()))
    expected = {
        "log_views_norm": z(np.log(chosen["views"])),
        "comments_per_view_norm": z(chosen["comments"] / chosen["views"]),
        "log_ratings_views_norm": z(np.log(total / chosen["views"])),
        "views_norm": z(chosen["views"]),
    }
    for name in RATINGS:
        share = counts.apply(lambda d, n=name: d[n]) / total
        expected[f"log_{name}_norm"] = z(np.log(share + LOG_OFFSET))
        expected[f"log_{name}_views_norm"] = z(np.log(share * np.log(chosen["views"]) + LOG_OFFSET))
    for name, value in expected.items():
        np.testing.assert_allclose(found[name].astype(float), value, atol=1e-9, err_msg=name)
        if name.startswith("log_"):
            assert (found[f"{name}_cat"].to_numpy() == level(value)).all(), name
    # 16 base columns, 8 per rating, 4 for the negative ratings; helpers come on top.
    named = {c for c in found if c.endswith("_norm_cat")}
    assert len(named) == 4 + 2 * 14 + 1


def test_zero_views_leave_one_level_missing(spark):
    ratings = F.array(F.struct(F.lit("OK").alias("name"), F.lit(1).cast("bigint").alias("count")))
    talks = spark.createDataFrame([(0, 1), (5, 2), (7, 3)], "views bigint, comments bigint").withColumn("ratings", ratings)
    out = {r["views"]: r for r in rating_targets(talks, ["OK"], []).collect()}
    assert out[0]["log_views_norm_cat"] is None and out[0]["log_comments_norm_cat"] is not None
    assert out[5]["log_views_norm_cat"] is not None
    with pytest.raises(Exception, match="no range holds"):
        rating_targets(talks, ["OK"], [], strict=True).collect()


def test_files_to_scores(spark, world, tmp_path):
    home, frame = world
    talks = popularity_targets(tables.read_talks(spark, str(home / "talks.csv")))
    features, excluded = talk_features(read_results(spark, str(home / "results")))
    mfcc = tables.read_mfcc(spark, str(home / "mfcc.parquet"))
    table, out = feature_table(talks, features, excluded, mfcc)
    reasons = {r["filename"]: r["reason"] for r in out.collect()}
    assert reasons == {"talk2": "no_result", "talk3": "lt2_utterances", "talk5": "no_mfcc"}
    tables.write_table(table.drop("transcript"), str(tmp_path / "features"))
    stored = spark.read.parquet(str(tmp_path / "features"))
    assert stored.count() == N - 5 and set(MODEL_COLUMNS) <= set(stored.columns)

    text = tables.read_text_embeddings(spark, str(home / "embeddings.csv"))
    levels = [f"log_{t}_norm_cat" for t in TARGETS]
    model = model_table(stored, text, levels)
    row = model.first()
    assert model.count() == N - 6  # one embedding is missing
    assert [len(row[c]) for c in ("x_embedding", "x_posterior", "x_mfcc", "x_gender", "x_text")] == [6, 38, 4, 1, 4]
    # Empty occupations come back from CSV as missing: talks 10, 15, ... 55.
    assert model_table(stored, text, levels, csv_parity=True).count() == N - 6 - 10

    sets = {k: FEATURE_SETS[k] for k in ("Audio-Text", "Posteriors+gender", "Baseline")}
    scores, first, errors = experiment(
        model, "url", {"views": "log_views_norm_cat"}, feature_sets=sets, folds=2,
        options={"kernel": {"landmarks": 20, "iterations": 5}, "forest": {"trees": 3, "depth": 3}})
    assert errors.collect() == []
    assert first.groupBy("type").count().count() == 3
    tables.write_table(scores, str(tmp_path / "scores"))
    tables.export_csv(scores, str(tmp_path / "scores.csv"))
    stored_scores = tables.read_scores(spark, str(tmp_path / "scores"))
    assert stored_scores.count() == 36
    assert sorted(tables.read_scores(spark, str(tmp_path / "scores.csv")).collect()) == sorted(stored_scores.collect())

    ranked = analysis.cohort_correlations(stored, "log_Beautiful_norm", "filename", n=20)
    rows = ranked.collect()
    assert len(rows) == 39
    sizes = [abs(r["r"]) for r in rows if r["r"] is not None]
    assert sizes == sorted(sizes, reverse=True)


def test_survey_columns(spark, world):
    home, frame = world
    talks = tables.read_talks(spark, str(home / "talks.csv")).withColumn("age", F.lit("31 - 45"))
    out = analysis.survey_columns(talks, "film_date").orderBy("film_date").toPandas()
    assert list(out["speaker_id"][:8]) == [0, 1, 2, 3, 4, 5, 6, 0]
    assert list(out["wc"][:3]) == [0, 4, 4] and (out["age"] == 2).all()
    np.testing.assert_allclose(out["wpm"], out["wc"] / (frame["duration"] / 60))
    np.testing.assert_allclose(out[list(RATINGS)].astype(float).sum(axis=1), 1)


def test_export_csv_writes_arrays_as_text(spark, tmp_path):
    df = spark.createDataFrame([("a \"b\"\nc", [1.0, 2.5])], "s string, v array<double>")
    tables.export_csv(df, str(tmp_path / "out"))
    back = tables._read_csv(spark, str(tmp_path / "out"), "s string, v string").first()
    assert back["s"] == "a \"b\"\nc" and json.loads(back["v"]) == [1.0, 2.5]
