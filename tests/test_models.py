import numpy as np
import pytest
from pyspark.ml import classification as ml
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from rostrum.operators import forest, kernel_ridge as ridge, machines, models
from rostrum.operators.components import wide_components
from rostrum.plans.experiment import cross_validate, experiment, holdout_run
from rostrum.vocab import LEVELS


@pytest.fixture(scope="module")
def planted(spark):
    """A level that depends on the distance from the origin: no line separates it."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (240, 4))
    d = (x[:, :2] ** 2).sum(axis=1)
    y = np.where(d < 0.7, "low", np.where(d < 2.5, "medium", "high"))
    rows = [(i, x[i].tolist(), x[i, :1].tolist(), str(y[i])) for i in range(len(x))]
    return spark.createDataFrame(
        rows, "id bigint, x_embedding array<double>, x_gender array<double>, y_cat string"
    ).repartition(2).persist()


def test_standardise_uses_population_deviation(spark):
    rows = [(0, [1.0, 5.0]), (1, [3.0, 5.0]), (2, [8.0, 5.0])]
    df = spark.createDataFrame(rows, "key int, x array<double>")
    other = spark.createDataFrame([(9, [4.0, 7.0])], "key int, x array<double>")
    (train, test), varying = models.standardise(df, [other])
    out = np.array([r[0] for r in train.orderBy("key").select(vector_to_array("x")).collect()])
    v = np.array([1.0, 3.0, 8.0])
    np.testing.assert_allclose(out[:, 0], (v - v.mean()) / v.std())
    assert (out[:, 1] == 0).all() and varying == 1
    assert test.select(vector_to_array("x")).first()[0] == pytest.approx([0.0, 0.0], abs=1e-12)


def test_kernel_map_is_exact_on_all_landmarks(spark, planted):
    (scaled,), varying = models.standardise(
        planted.select(F.col("id").alias("key"), "y_cat", F.col("x_embedding").alias("x")), [])
    mapped = models.kernel_map(scaled, 0.25, landmarks=1000)
    rows = scaled.select(
        vector_to_array("x").alias("x"), vector_to_array(mapped("x")).alias("k")).collect()
    x, k = (np.array([r[c] for r in rows]) for c in ("x", "k"))
    exact = np.exp(-0.25 * ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.testing.assert_allclose(k @ k.T, exact, atol=1e-4)
    assert varying == 4


def test_grid_beats_the_baseline_and_survives_a_failure(spark, planted):
    sets = {"Embeddings": ("x_embedding",), "Posteriors": ("x_embedding",),
            "Gender": ("nothing",), "Baseline": ("x_embedding",)}
    table = planted.withColumn("nothing", F.array(F.lit(None).cast("double")))
    options = {"kernel": {"landmarks": 60, "iterations": 20}, "forest": {"trees": 10, "depth": 6}}
    scores, _, errors = experiment(
        table, "id", {"views": "y_cat"}, feature_sets=sets, folds=2, options=options)
    assert [(r["target"], r["type"]) for r in errors.collect()] == [("views", "Gender")]
    value = {(r["type"], r["metric"]): r["value"] for r in scores.collect()}
    assert len(value) == 3 * 12 and all(0 <= v <= 1 for v in value.values())
    for kind in ("Embeddings", "Posteriors"):
        assert value[kind, "f1_weighted"] > value["Baseline", "f1_weighted"] + 0.2
        assert value[kind, "auc_low"] > 0.8


def test_predictions_cover_every_row_once(spark, planted):
    sets = {"Posteriors": ("x_embedding",)}
    out, failed = cross_validate(planted, "id", {"t": "y_cat"}, sets, folds=3,
                                 options={"forest": {"trees": 3, "depth": 3}})
    assert failed == []
    rows = out.collect()
    assert sorted(r["key"] for r in rows) == list(range(240))
    assert all(abs(r["low"] + r["medium"] + r["high"] - 1) < 1e-9 for r in rows)
    assert {r["fold"] for r in rows} == {0, 1, 2}


def test_baseline_follows_the_priors_of_the_other_folds(spark):
    df = spark.range(6000).select(
        F.col("id").alias("key"), (F.col("id") % 5).alias("fold"),
        F.when(F.col("id") % 10 < 2, "low").when(F.col("id") % 10 < 9, "medium").otherwise("high").alias("y"))
    out = models.stratified_baseline(df, LEVELS)
    shares = {r["p"]: r["count"] / 6000 for r in out.groupBy("p").count().collect()}
    assert shares == pytest.approx({"low": 0.2, "medium": 0.7, "high": 0.1}, abs=0.03)
    one_sided = df.withColumn("y", F.when(F.col("fold") == 0, "low").otherwise("high"))
    drawn = models.stratified_baseline(one_sided, LEVELS).where("fold = 0").select("p").distinct()
    assert [r["p"] for r in drawn.collect()] == ["high"]


def test_holdout_run(spark, planted):
    scores, table = holdout_run(planted, "id", "y_cat", ("x_embedding",), "forest", trees=10, depth=6)
    out = scores.first()
    assert out["target"] == "y_cat" and 0.5 < out["accuracy"] <= 1
    cells = table.collect()
    assert len(cells) == 9
    hits = sum(r["n"] for r in cells if r["y"] == r["p"])
    assert hits / sum(r["n"] for r in cells) == pytest.approx(out["accuracy"])


def forest_tables(planted):
    rows = planted.select(F.col("id").alias("key"), F.col("y_cat").alias("y"), array_to_vector("x_embedding").alias("x"))
    return rows.where("key % 4 > 0"), rows.where("key % 4 = 0")


def test_a_forest_does_not_depend_on_how_it_is_split_up(planted):
    train, test = forest_tables(planted)
    options = dict(trees=7, depth=30)
    whole = sorted(models.forest(train, test, LEVELS, **options).collect())
    # Upper nodes split by passes, a few of them a pass, over other partitions.
    parts = models.forest(
        train.repartition(5, "x"), test.repartition(3), LEVELS, group_rows=20, memory_mb=1, **options)
    assert sorted(parts.collect()) == whole and len(whole) == 60
    other = models.forest(train, test, LEVELS, seed=1, **options)
    assert sorted(other.collect()) != whole


def test_forest_keeps_its_nodes_off_the_driver(planted):
    train, test = forest_tables(planted)
    plan = models.forest(train, test, LEVELS, trees=3)._jdf.queryExecution().toString()
    # The test rows are voted on where the nodes below are grown, not by a model from the driver.
    assert plan.count("MapInArrow") >= 3 and "RepartitionByExpression" in plan


def test_forest_learns_and_leaves_are_pure(planted):
    train, _ = forest_tables(planted)
    out = models.forest(train, train, LEVELS, trees=40).collect()
    assert sum(r["p"] == r["y"] for r in out) / len(out) > 0.97
    assert all(r["p"] == max(LEVELS, key=lambda c: r[c]) and abs(sum(r[c] for c in LEVELS) - 1) < 1e-9 for r in out)


def test_forest_of_awkward_tables(spark, planted):
    schema = "key bigint, y string, x array<double>"
    # Null and repeated keys, a constant and a rare value: rows stay, the rare value is split at.
    rows = [(None if i % 2 else 5, "high" if i % 50 == 0 else "low", [1.0, float(i % 50 == 0)]) for i in range(400)]
    df = spark.createDataFrame(rows, schema).withColumn("x", array_to_vector("x"))
    out = models.forest(df, df, LEVELS, trees=9, group_rows=50).collect()
    assert len(out) == 400 and all(r["p"] == r["y"] and r["medium"] == 0 for r in out)
    for bad in ([(1, "none", [1.0])], [(1, "low", [float("nan")])], [(1, "low", [1.0]), (2, "low", [1.0, 2.0])]):
        with pytest.raises(Exception):
            train = spark.createDataFrame(bad, schema).withColumn("x", array_to_vector("x"))
            models.forest(train, train, LEVELS, trees=2).collect()
    with pytest.raises(ValueError):
        models.forest(df.where("false"), df, LEVELS)


def test_best_splits_are_those_of_all_splits():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (60, 4)).astype(np.uint8)
    y, w = (x[:, 2] > 2).astype(np.uint8) + (rng.random(60) < 0.2).astype(np.uint8), rng.integers(1, 4, 60).astype(np.uint8)
    picks, row = np.array([[0, 2, 3]]), np.arange(60)
    hist = forest.tally(x, row, y, w, np.zeros(60, dtype=int), picks, 3)
    position, cut, sides = forest.best_splits(hist, picks, 1)

    def gini(part):
        n = np.bincount(y[part], w[part], 3)
        return n.sum() - (n ** 2).sum() / n.sum()

    tried = {(p, c): gini(x[:, p] <= c) + gini(x[:, p] > c) for p in (0, 2, 3) for c in range(5)}
    assert tried[position[0], cut[0]] == pytest.approx(min(tried.values()))
    np.testing.assert_array_equal(sides[0, 0], np.bincount(y[x[:, position[0]] <= cut[0]], w[x[:, position[0]] <= cut[0]], 3))


def test_kernel_machines_of_small_tables_need_no_shuffle(planted, monkeypatch):
    tasks, fit = [], models.OneVsRest.fit
    monkeypatch.setattr(
        models.OneVsRest, "fit", lambda self, df: tasks.append(df.rdd.getNumPartitions()) or fit(self, df))
    train, test = forest_tables(planted)
    train = train.repartition(6)
    out = models.kernel_svc(train, test, LEVELS, 0.25, landmarks=60, iterations=5)
    assert out.count() == 60 and tasks == [1]
    monkeypatch.setattr(models, "TASK_CELLS", 60 * 60)  # 180 rows: three tasks
    models.kernel_svc(train, test, LEVELS, 0.25, landmarks=60, iterations=5)
    assert tasks == [1, 3]


def test_machines_are_those_of_spark_in_a_pass_per_step(planted, monkeypatch):
    train, _ = forest_tables(planted)
    passes, fit = [], machines._fit
    monkeypatch.setattr(machines, "_fit", lambda *a: fit(*a[:-1], lambda *p: passes.append(1) or a[-1](*p)))
    mapped, size = models.kernel_features(train, 0.25, 40)
    rows = train.select(models.label_index(LEVELS).alias("label"), vector_to_array("x").alias("x"))
    single, several = (machines.OneVsRest(mapped, size, 1 / 36000, 50).fit(rows.repartition(n)).weights for n in (1, 3))
    expected = ml.OneVsRest(
        classifier=ml.LinearSVC(regParam=1 / 36000, maxIter=50, standardization=False), featuresCol="k", parallelism=1,
    ).fit(rows.select("label", models.kernel_map(train, 0.25, 40)(array_to_vector("x")).alias("k")).coalesce(1))
    expected = np.array([[*m.coefficients.toArray(), m.intercept] for m in expected.models])
    for weights in (single, several):
        np.testing.assert_allclose(weights, expected, rtol=1e-4, atol=1e-6 * np.abs(expected).max())
    assert 50 <= len(passes) <= 75  # Spark runs a job for each of some hundred points


def test_machines_refuse_what_they_cannot_learn(spark):
    for label, x in ((-1.0, 1.0), (None, 1.0), (0.0, float("nan"))):
        rows = spark.createDataFrame([(0.0, [1.0]), (1.0, [2.0]), (label, [x])], "label double, x array<double>")
        with pytest.raises(Exception, match="known class|finite"):
            machines.OneVsRest(lambda v: v, 1, 0.1, 5).fit(rows)


def test_kernel_svc_of_awkward_tables(spark):
    # Null and repeated keys, a class that training lacks, a constant position.
    rows = [(None if i % 2 else 5, "low" if i % 3 else "medium", [float(i % 3), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "key bigint, y string, x array<double>").withColumn("x", array_to_vector("x"))
    out = models.kernel_svc(df, df, LEVELS, 0.5, landmarks=20, iterations=20).collect()
    assert len(out) == 60 and all(r["p"] == r["y"] and r["high"] == 0 for r in out)
    assert models.kernel_svc(df, df.where("false"), LEVELS, 0.5, landmarks=20, iterations=5).collect() == []


def test_a_failed_run_fails_cv_scores(spark, planted, tmp_path, monkeypatch):
    from rostrum.bindings import learning
    from rostrum.plans import experiment as plan
    table = planted.select("id", "x_embedding", "y_cat").withColumn("nothing", F.array(F.lit(None).cast("double")))
    sets = {"Gender": ("nothing",), "Baseline": ("x_embedding",)}
    with pytest.raises(RuntimeError, match="runs failed.*'Gender'"):
        cross_validate(table, "id", {"t": "y_cat"}, sets, folds=2, options=FEW, whole=True)

    def fails(train, test, kind, labels, **options):
        if kind == "kernel":
            raise RuntimeError("the cluster went away")
        return models.stratified_baseline(test.withColumn("fold", F.lit(0)), labels).drop("fold")

    monkeypatch.setattr(plan, "predict", fails)
    spark.range(60).select(F.col("id").alias("vec_id"), F.array(*[
        F.sin(F.col("id") * k).cast("float") for k in range(1, 7)]).alias("embedding")
    ).write.parquet(str(tmp_path / "embeddings.parquet"))
    with pytest.raises(RuntimeError, match="cluster went away"):
        learning.cv_scores(spark, str(tmp_path))


def test_rows_without_a_level_fail_no_run(planted):
    missing = planted.where("id < 5").select(
        F.col("id") + 1000, F.lit(None).cast("array<double>"), F.array(F.lit(None).cast("double")), F.lit(None).cast("string"))
    table = planted.withColumn("x_gender", F.array((F.get("x_gender", F.lit(0)) > 0).cast("double"))).union(missing)
    sets = {"Gender": ("x_gender",), "Posteriors+gender": ("x_embedding", "x_gender")}
    out, failed = cross_validate(table, "id", {"t": "y_cat"}, sets, folds=2, options=FEW, whole=True)
    assert failed == [] and out.count() == 2 * 240


def test_holdout_scores_do_not_depend_on_how_its_forest_is_split_up(planted):
    once, again = (holdout_run(rows, "id", "y_cat", ("x_embedding",), "forest", trees=10, group_rows=size)[0].collect()
                   for rows, size in ((planted, 1 << 15), (planted.repartition(5), 25)))
    assert once == again


def test_unscaled_kernel_width(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 5, (50, 4))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    assert models.scale_width(df) == pytest.approx(1 / (4 * x.var()))


def test_balanced_grid_folds(spark, planted):
    out, _ = cross_validate(planted, "id", {"t": "y_cat"}, {"Baseline": ("x_embedding",)}, folds=7, balanced=True)
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_principal_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (60, 3)) @ np.array([[2, 1, 0], [0, 1, 1], [0, 0, 0.3]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k int, v array<double>")
    out = models.principal_components(df, "v").orderBy("k").collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    for i in range(2):
        axis = axes[i] * np.sign(axes[i][np.abs(axes[i]).argmax()])
        np.testing.assert_allclose([r[f"pc{i + 1}"] for r in out], z @ axis, atol=1e-8)


def grid_sets():
    return {"Posteriors": ("x_embedding",), "Gender": ("x_embedding",), "Baseline": ("x_embedding",)}


FEW = {"forest": {"trees": 3, "depth": 3}}


def test_a_stopped_grid_fits_only_the_rest(spark, planted, tmp_path, monkeypatch):
    from rostrum.plans import experiment as plan
    fitted, fit = [], plan.fold_predictions

    def stops(table, kind, vectors, labels, fold, **options):
        fitted.append(fold)
        if len(fitted) > 3:
            raise RuntimeError("the cluster went away")
        return fit(table, kind, vectors, labels, fold, **options)

    keep, table = str(tmp_path / "grid"), planted.select("id", "x_embedding", "y_cat")
    arguments = dict(folds=3, threads=1, options=FEW, keep=keep)
    monkeypatch.setattr(plan, "fold_predictions", stops)
    first, failed = cross_validate(table, "id", {"a/b c": "y_cat"}, grid_sets(), **arguments)
    assert [f[:2] for f in failed] == [("a/b c", "Gender")] and "went away" in failed[0][2]
    assert plan.ledger(spark, keep).count() == 3 + 3  # one forest and the baseline

    again = []
    monkeypatch.setattr(plan, "fold_predictions", lambda *a, **o: again.append(a[4]) or fit(*a, **o))
    out, failed = cross_validate(table.repartition(3), "id", {"a/b c": "y_cat"}, grid_sets(), **arguments)
    assert failed == [] and again == [0, 1, 2]
    assert out.count() == 3 * 240
    assert sorted((r["type"], r["fold"]) for r in plan.ledger(spark, keep).collect()) == sorted(
        (t, k) for t in grid_sets() for k in range(3))
    # Other rows or settings are another grid.
    again.clear()
    cross_validate(table, "id", {"a/b c": "y_cat"}, grid_sets(), **(arguments | {"options": {"forest": {"trees": 2, "depth": 2}}}))
    assert len(again) == 6
    # What was finished is taken as it is: a forest drawn again would differ.
    before, after = set(map(tuple, first.collect())), set(map(tuple, out.collect()))
    assert before < after and {r[1] for r in after - before} == {"Gender"}


def test_a_run_that_hangs_is_stopped(spark, planted, monkeypatch):
    from rostrum.plans import experiment as plan
    fit = plan.fold_predictions

    @F.udf("double")
    def slow(x):
        import time
        time.sleep(60)
        return x

    def hangs(table, kind, vectors, labels, fold, **options):
        out = fit(table, kind, vectors, labels, fold, **options)
        return out.withColumn("low", slow("low")) if vectors == ("x_other",) else out

    monkeypatch.setattr(plan, "fold_predictions", hangs)
    table = planted.withColumn("x_other", F.col("x_embedding"))
    out, failed = cross_validate(table, "id", {"t": "y_cat"}, {"Gender": ("x_other",), "Posteriors": ("x_embedding",)},
                                 folds=2, options=FEW, limit=15)
    assert [f[:2] for f in failed] == [("t", "Gender")] and "stopped after 15 seconds" in failed[0][2]
    assert {r["type"] for r in out.select("type").distinct().collect()} == {"Posteriors"}


def dense_ridge(x, y, gamma, penalty, asked):
    """Margins of the exact kernel solution."""
    kernel = lambda a, b: np.exp(-gamma * ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return kernel(asked, x) @ np.linalg.solve(kernel(x, x) + penalty * np.eye(len(x)), y)


@pytest.fixture(scope="module")
def ridge_rows(spark, planted):
    """The planted rows, three of them twice, as key, x and label, and as arrays."""
    rows = planted.unionByName(planted.where("id < 3").withColumn("id", F.col("id") + 1000)).withColumnRenamed(
        "y_cat", "y").select(
        F.col("id").alias("key"), F.col("x_embedding").alias("x"), models.label_index(LEVELS).alias("label"))
    got = rows.orderBy("key").collect()
    x, label = np.array([r["x"] for r in got]), np.array([r["label"] for r in got])
    return rows, x, np.where(label[:, None] == np.arange(3)[None, :], 1.0, -1.0)


def test_ridge_is_exact_on_all_landmarks(ridge_rows):
    rows, x, y = ridge_rows
    points, stands = ridge.leverage_landmarks(rows, 0.25, 0.1, landmarks=1000, pilot=50)
    assert len(points) == 240 and sorted(stands) == [1.0] * 237 + [2.0] * 3
    weights, steps = ridge.solve(rows, 3, points, stands, 0.25, 0.1)
    asked = np.random.default_rng(1).normal(0, 1, (50, 4))
    np.testing.assert_allclose(
        ridge.rbf(asked, points, 0.25) @ weights, dense_ridge(x, y, 0.25, 0.1, asked), atol=1e-3)
    assert steps < 20


def test_ridge_nears_the_exact_solution_with_its_landmarks(spark, ridge_rows):
    rows, x, y = ridge_rows
    exact, off = dense_ridge(x, y, 0.25, 1.0, x), []
    for landmarks in (15, 60, 150):
        points, stands = ridge.leverage_landmarks(rows, 0.25, 1.0, landmarks, pilot=40)
        again, _ = ridge.leverage_landmarks(rows.repartition(7), 0.25, 1.0, landmarks, pilot=40)
        np.testing.assert_array_equal(points, again)
        weights, _ = ridge.solve(rows, 3, points, stands, 0.25, 1.0)
        off.append(np.abs(ridge.rbf(x, points, 0.25) @ weights - exact).mean())
    assert off[0] > off[1] > off[2] and off[2] < 0.01


def test_ridge_in_the_grid(spark, planted):
    options = {"kernel": {"machine": "ridge", "landmarks": 100, "pilot": 40}}
    scores, _ = holdout_run(planted, "id", "y_cat", ("x_embedding",), "kernel", machine="ridge", landmarks=100)
    majority = planted.groupBy("y_cat").count().agg(F.max("count")).first()[0] / 240
    assert scores.first()["accuracy"] > majority + 0.2
    out, failed = cross_validate(
        planted, "id", {"t": "y_cat"}, {"Embeddings": ("x_embedding",)}, folds=2, options=options)
    assert failed == []
    rows = out.collect()
    assert sorted(r["key"] for r in rows) == list(range(240))
    assert all(abs(r["low"] + r["medium"] + r["high"] - 1) < 1e-9 for r in rows)
    assert sum(r["p"] == r["y"] for r in rows) / 240 > majority + 0.2


def test_wide_components_equal_principal_components(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one, two = (f(df, "v", 3).orderBy("vec_id").drop("vec_id").toPandas().to_numpy()
                for f in (models.principal_components, wide_components))
    np.testing.assert_allclose(np.abs(one), np.abs(two), atol=1e-6)


def test_wide_components_of_awkward_tables(spark):
    # More positions than rows, a constant position, equal rows; then few positions, then none.
    rng = np.random.default_rng(3)
    x = np.outer(rng.normal(0, 3, 30), rng.normal(0, 1, 400)) + rng.normal(0, 0.1, (30, 400))
    x[:, 5], x[7] = 2.0, x[6]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    out = wide_components(df, "v").orderBy("id").toPandas()
    z = np.divide(x - x.mean(axis=0), x.std(axis=0), out=np.zeros_like(x), where=x.std(axis=0) > 1e-12)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    np.testing.assert_allclose(np.abs(out["pc1"]), np.abs(u[:, 0] * s[0]), atol=1e-6)
    assert out["pc1"][6] == out["pc1"][7]
    narrow = spark.createDataFrame([(1, [1.0]), (2, [3.0])], "id int, v array<double>")
    assert [(r["pc1"], r["pc2"]) for r in wide_components(narrow, "v").orderBy("id").collect()] == [
        (-1.0, None), (1.0, None)]
    assert wide_components(df.where("id < 0"), "v").collect() == []
