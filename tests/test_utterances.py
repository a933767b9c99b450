import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import utterances as U
from rostrum.operators.order_stats import describe
from rostrum.plans.features import feature_table, talk_features
from rostrum.sources.results import explode_predictions, read_results


def prediction(id, start, end, task, labels=(), embedding=None):
    out = {"id": id, "startTime": start, "endTime": end, "task": task,
           "prediction": [{"label": a, "posterior": b} for a, b in labels]}
    if embedding is not None:
        out["embedding"] = embedding
    return out


FIXTURE = [
    prediction(1, "0.0", "2.0", "emotion", [("angry", .1), ("happy", .6), ("sad", .1), ("neutral", .2)]),
    prediction(1, "0.5", "9.0", "strength", [("weak", .2), ("neutral", .5), ("strong", ".3")]),
    prediction(1, "0.0", "2.0", "features", embedding="[1.0, 2.0]"),
    prediction(2, "3.0", "6.0", "emotion", [("angry", .3), ("happy", .2), ("sad", .4), ("neutral", .1)]),
    prediction(2, "3.0", "6.0", "features", embedding="[3.0, 6.0]"),
    prediction(1, "0.0", "2.0", "emotion", [("angry", 0), ("happy", .8), ("sad", .1), ("neutral", .1)]),
    prediction(3, 5.5, 6.5, "emotion", [("surprised", .9), ("happy", .4), ("happy", .5)]),
]


def documents(spark, **talks):
    rows = [(name, json.dumps({"first": items, "second": []})) for name, items in talks.items()]
    df = spark.createDataFrame(rows, "filename string, document string")
    return explode_predictions(df, "filename", "document")


def test_worked_fixture(spark):
    features, excluded = talk_features(documents(spark, a=FIXTURE))
    assert excluded.collect() == []
    row = features.first().asDict()
    expected = {
        "turn_durations_mean": 2.0, "turn_durations_std": 0.816496580927726,
        "turn_durations_10p": 1.2, "turn_durations_90p": 2.8,
        "pauses_mean": 0.25, "pauses_std": 0.75, "pauses_10p": -0.35, "pauses_90p": 0.85,
        "emotion_happy_mean": 0.5, "emotion_happy_std": 0.244948974278318,
        "emotion_happy_90p": 0.74, "emotion_angry_mean": 0.15, "emotion_angry_std": 0.15,
        "emotion_angry_90p": 0.27, "strength_strong_mean": 0.3,
    }
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, abs=1e-12), name
    assert row["gender_male_mean"] is None and row["positivity_neutral_std"] is None
    assert row["features_embedding_mean"] == pytest.approx([2.2, 4.4])
    assert row["features_embedding_std"] == pytest.approx([0.979795897113271, 1.95959179422654])
    assert len(row) == 1 + 36 + 8 + 2


def test_results_are_read_from_a_folder(spark, tmp_path):
    (tmp_path / "talk one+b.json").write_text(json.dumps({"k": FIXTURE}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"k": FIXTURE[:1]}))
    (tmp_path / "note.txt").write_text("no")
    rows = read_results(spark, str(tmp_path))
    counts = {r["filename"]: r["count"] for r in rows.groupBy("filename").count().collect()}
    assert counts == {"talk one+b": 7, "b": 1}


def test_talks_left_out_have_a_reason(spark):
    emotion = [("happy", .5)]
    talks = dict(
        good=FIXTURE,
        short=[prediction(1, 0, 1, "features", embedding="[1]")],
        dumb=[prediction(1, 0, 1, "emotion", emotion), prediction(2, 2, 3, "emotion", emotion)],
        zero=[prediction(1, 1, 1, "features", embedding="[1]"), prediction(2, 2, 3, "emotion", emotion)],
        badtime=[prediction(1, "x", 1, "features", embedding="[1]"), prediction(2, 2, 3, "emotion", emotion)],
        badlabel=[prediction(1, 0, 1, "features", embedding="[1]"), prediction(2, 2, 3, "emotion", [("sad", "?")])],
        badvector=[prediction(1, 0, 1, "features", embedding="[1, oops]"), prediction(2, 2, 3, "emotion", emotion)],
        uneven=[prediction(1, 0, 1, "features", embedding="[1]"), prediction(2, 2, 3, "features", embedding="[1, 2]")],
        # An unknown label may be anything.
        other=[prediction(1, 0, 1, "features", embedding="[1]"), prediction(2, 2, 3, "emotion", [("odd", "?")])],
    )
    features, excluded = talk_features(documents(spark, **talks))
    assert {r["filename"] for r in features.collect()} == {"good", "other"}
    assert {r["filename"]: r["reason"] for r in excluded.collect()} == {
        "short": "lt2_utterances", "dumb": "no_embedding", "zero": "no_embedding",
        "badtime": "bad_number", "badlabel": "bad_number", "badvector": "bad_number",
        "uneven": "uneven_embedding",
    }
    talks_table = spark.createDataFrame([("good",), ("short",), ("other",), ("lost",)], "filename string")
    mfcc = spark.createDataFrame([("good", [1.0], [0.0])], "filename string, mfccs_mean array<double>, mfccs_std array<double>")
    table, out = feature_table(talks_table, features, excluded, mfcc)
    assert [r["filename"] for r in table.collect()] == ["good"]
    assert {r["filename"]: r["reason"] for r in out.collect()} == {
        "short": "lt2_utterances", "other": "no_mfcc", "lost": "no_result"}


@pytest.mark.parametrize("width", [1, 3, 64, 1 << 20])
def test_pauses_do_not_depend_on_the_slices(spark, width):
    rng = np.random.default_rng(5)
    order = rng.choice(500, 200, replace=False)
    rows = [(int(o) % 3 and "hot", int(o), float(o), float(o) + float(rng.random())) for o in order]
    df = spark.createDataFrame(
        [(str(k), o, s, e) for k, o, s, e in rows], "talk string, ord bigint, st double, et double"
    ).repartition(5)
    expected = []
    for talk in {str(r[0]) for r in rows}:
        mine = sorted(r[1:] for r in rows if str(r[0]) == talk)
        expected += [(talk, b[1] - a[2]) for a, b in zip(mine, mine[1:])]
    found = [(r["talk"], r["value"]) for r in U.pauses(df, "talk", width).collect()]
    assert sorted(found) == sorted(expected)


def test_results_do_not_depend_on_row_order(spark):
    rows = documents(spark, a=FIXTURE, b=FIXTURE[2:])
    one = U.utterances(rows.orderBy("pos").coalesce(1), "filename")
    other = U.utterances(rows.orderBy(F.desc("pos")).repartition(4), "filename")
    key = ["filename", "id"]
    assert one.orderBy(*key).collect() == other.orderBy(*key).collect()
    stats = describe(U.label_values(one, "filename"), ["filename", "measure"], "value")
    assert stats.where("filename = 'b' and measure = 'emotion_happy'").first()["n"] == 3


def test_documents_with_other_keys(spark):
    rows = {
        "one": '{"a":[{"id":1}]}', "later": '{"a":[{"id":1}],"v":"1.2"}', "before": '{"v":"1.2","a":[{"id":1}]}',
        "two": '{"b":[{"id":2}],"a":[{"id":3},{"id":4}]}', "null": '{"a":null,"b":[{"id":1}]}', "empty": '{"a":[]}',
        "odd": '{"a":[1,{"id":2}]}', "cut": '{"a":[{"id":1}]', "none": "{}", "list": '[{"id":1}]', "nested": '{"a":[{"id":5}],"v":{"x":[1]}}',
    }
    df = spark.createDataFrame(list(rows.items()), "filename string, document string")
    got = {}
    for r in explode_predictions(df, "filename", "document").collect():
        got.setdefault(r["filename"], []).append(r["id"] if r["pos"] is not None else "bad")
    assert got == {"one": ["1"], "later": ["1"], "before": ["bad"], "two": ["2"], "null": ["bad"], "odd": ["bad"],
                   "cut": ["bad"], "none": ["bad"], "list": ["bad"], "nested": ["5"]}
