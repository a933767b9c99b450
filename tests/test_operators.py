import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rostrum.operators import positions as P
from rostrum.operators import summaries as S
from rostrum.operators.correlate import corr_long, corr_matrix, corr_rank, corr_table
from rostrum.operators.order_stats import describe, equal_part
from rostrum.operators.vector_stats import weighted_vector_stats
from rostrum.operators.zscore import zscore


def test_describe_equals_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    groups = {
        "hot": np.concatenate([rng.normal(0, 1, 30000), np.full(5000, 0.25)]),
        "two": np.array([1.0, 2.0]), "one": np.array([-3.5]), "same": np.full(7, 0.1),
        "near": 1 + rng.random(200) * 1e-6, "wide": rng.normal(0, 1, 101) * 10.0 ** rng.integers(-8, 8, 101),
        None: rng.integers(-3, 3, 50).astype(float),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("one", None), ("none", None)]
    out = describe(spark.createDataFrame(rows, "k string, x double").repartition(6), ["k"], "x",
                   (0.1, 0.5, 0.9))
    found = {r["k"]: r for r in out.collect()}
    assert set(found) == set(groups)
    for k, v in groups.items():
        r = found[k]
        assert r["n"] == len(v)
        assert r["mean"] == pytest.approx(v.mean(), rel=1e-9, abs=1e-12)
        assert r["std"] == pytest.approx(v.std(), rel=1e-7, abs=1e-12)
        for q in (10, 50, 90):
            assert r[f"p{q}"] == pytest.approx(np.percentile(v, q), rel=1e-12, abs=1e-15), (k, q)
    assert found["same"]["std"] == 0.0


def test_describe_spoilt_group(spark):
    rows = [("a", 1.0), ("a", float("nan")), ("b", 1.0), ("c", float("inf"))]
    out = describe(spark.createDataFrame(rows, "k string, x double"), ["k"], "x")
    found = {r["k"]: tuple(r)[1:] for r in out.collect()}
    assert found["a"] == (2, None, None, None, None)
    assert found["b"] == (1, 1.0, 0.0, 1.0, 1.0)
    assert found["c"] == (1, None, None, None, None)


def weighted(v, w):
    m = np.average(v, axis=0, weights=w)
    with np.errstate(invalid="ignore"):
        return m, np.sqrt(np.average((v - m) ** 2, axis=0, weights=w))


def test_weighted_vector_stats_equals_numpy(spark):
    rng = np.random.default_rng(2)
    cases = {
        "plain": (rng.normal(5, 1, (40, 3)), rng.random(40)),
        "single": (np.array([[1.0, 2.0, 3.0]]), np.array([2.5])),
        "signed": (rng.normal(0, 1, (20, 3)), np.r_[-1.0, -0.5, 0.0, np.arange(1, 18)]),
        "minus": (rng.normal(0, 1, (5, 3)), -np.arange(1.0, 6.0)),
        "fixture": (np.array([[1.0, 2.0, 0.0], [3.0, 6.0, 0.0]]), np.array([2.0, 3.0])),
    }
    rows = [(k, v.tolist(), float(w)) for k, (vs, ws) in cases.items() for v, w in zip(vs, ws)]
    rows += [("zero", [1.0], 1.0), ("zero", [2.0], -1.0), ("nil", [1.0], 0.0),
             ("uneven", [1.0], 1.0), ("uneven", [1.0, 2.0], 1.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v array<double>, w double").repartition(3)
    found = {r["k"]: r for r in weighted_vector_stats(df, ["k"], "v", "w").collect()}
    for k, (v, w) in cases.items():
        m, s = weighted(v, w)
        np.testing.assert_allclose(found[k]["vec_mean"], m, rtol=1e-9, atol=1e-12)
        # The root of a negative sum is no number there and missing here.
        got = np.array([np.nan if x is None else x for x in found[k]["vec_std"]])
        np.testing.assert_allclose(got, s, rtol=1e-8, atol=1e-12)
        assert found[k]["vectors"] == len(v)
    assert found["fixture"]["vec_std"][:2] == pytest.approx([0.979795897113271, 1.95959179422654])
    for k in ("zero", "nil", "uneven"):
        assert found[k]["vec_mean"] is None and found[k]["vec_std"] is None
    assert "none" not in found


def test_zscore_properties(spark):
    df = spark.createDataFrame([(float(i * i), 3.0, None if i % 3 else 1.0 * i) for i in range(50)]
                               + [(None, 3.0, None)], "a double, b double, c double")
    out = zscore(df, ["a", "b", "c"]).toPandas()
    assert out["a_norm"].mean() == pytest.approx(0, abs=1e-12)
    assert out["a_norm"].std() == pytest.approx(1)
    assert out["b_norm"].isna().all() and out["c_norm"].notna().sum() == 17
    assert zscore(df, {"a": "z"}, ddof=0).toPandas()["z"].std(ddof=0) == pytest.approx(1)


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (500, 5))
    base[:, 1] += base[:, 0]
    base[:, 2] = base[:, 2] * 1e-3 + 1.7e9
    base[:, 4] = 8.1
    data = pd.DataFrame(base, columns=list("abcde")).mask(rng.random((500, 5)) < 0.1)
    # Shifted, so that the reference value itself loses no digits.
    expected = data.sub(data.iloc[0].fillna(1.7e9)).corr()
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(),
                               ", ".join(f"{c} double" for c in data)).repartition(5)
    rows = corr_matrix(df, list(data)).collect()
    assert len(rows) == 10
    for r in rows:
        if "e" in (r["a"], r["b"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(expected.loc[r["a"], r["b"]], abs=1e-7)
            assert r["n"] == data[[r["a"], r["b"]]].dropna().shape[0]


def test_correlation_fixtures(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0), (None, 2.0), (3.0, 3.0), (5.0, None), (7.0, 2.0)], "x double, y double")
    assert corr_long(df, ["x"], ["y"]).first()["r"] == pytest.approx(0.3273268353539886)
    df = spark.createDataFrame(
        [(1.0, 1.0), (float("inf"), 2.0), (3.0, 3.0), (4.0, 9.0)], "x double, y double")
    assert corr_long(df, ["x"], ["y"]).first()["r"] == pytest.approx(0.8910421112136305)


def test_corr_table_and_rank(spark):
    df = spark.range(100).select(
        F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"),
        (F.col("id") % 2).cast("double").alias("c"), F.lit(1.0).alias("d"))
    table = corr_table(df, ["a", "b"], ["b", "c"], 0.2).collect()
    assert [tuple(r) for r in table] == [("a", "-1.0", "-"), ("b", "1.0", "-")]
    assert [r["feature"] for r in corr_rank(df, ["d", "c", "b"], "a").collect()] == ["b", "c", "d"]


def test_positions_follow_the_order(spark):
    rng = np.random.default_rng(4)
    keys = np.unique(np.concatenate([rng.integers(0, 50, 40), rng.integers(0, 10 ** 12, 300)]))
    keys = [-(2 ** 63), *keys.tolist(), 2 ** 60, 2 ** 63 - 1]  # far out, and wider than a bigint
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(7)
    out = P.with_position(df, "k").orderBy("k").collect()
    assert [r["position"] for r in out] == list(range(len(keys)))


def test_an_outlier_or_a_tie_does_not_gather_the_rows(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") == 0, 1 << 60).when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id"
    )
    out = P.with_position(df, "k", ["id"])
    rows = out.orderBy("k", "id").collect()
    assert [r["position"] for r in rows] == list(range(20_000))
    sizes = [r["count"] for r in df.repartitionByRange(8, "k", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 12_000


def test_describe_of_close_values(spark):
    rng = np.random.default_rng(6)
    v = rng.uniform(0.995, 1.0, 50_000)
    df = spark.createDataFrame([(float(x),) for x in v], "x double").withColumn("k", F.lit("hot"))
    lo, hi = float(v.min()), float(v.max())
    parts = df.groupBy(equal_part(F.col("x"), F.lit(lo), F.lit(hi)).alias("p")).count()
    assert parts.agg(F.max("count")).first()[0] < 100
    out = describe(df, ["k"], "x", (0.1, 0.5, 0.9)).first()
    assert out["n"] == len(v) and out["mean"] == pytest.approx(v.mean(), rel=1e-12)
    assert out["std"] == pytest.approx(v.std(), rel=1e-9)
    for q in (10, 50, 90):
        assert out[f"p{q}"] == pytest.approx(np.percentile(v, q), rel=1e-14)


def test_appearance_codes(spark):
    rows = [(5, "b"), (1, "z"), (2, "a"), (3, "z"), (9, None)]
    df = spark.createDataFrame(rows, "k bigint, s string").repartition(3)
    codes = {r["s"]: r["code"] for r in P.appearance_codes(df, "s", "k").collect()}
    assert codes == {"z": 0, "a": 1, "b": 2, None: 3}
    added = {r["k"]: r["c"] for r in P.add_appearance_code(df, "s", "k", "c").collect()}
    assert added == {5: 2, 1: 0, 2: 1, 3: 0, 9: 3}


@pytest.mark.parametrize("n, folds", [(7, 3), (100, 5), (3, 5), (23, 5)])
def test_balanced_folds_have_even_sizes(spark, n, folds):
    out = P.balanced_folds(spark.range(n), "id", folds).groupBy("fold").count().collect()
    sizes = {r["fold"]: r["count"] for r in out}
    expected = {k: n // folds + (k < n % folds) for k in range(folds) if n // folds + (k < n % folds)}
    assert sizes == expected


def test_folds_do_not_depend_on_partitions(spark):
    one, many = (P.hash_folds(spark.range(0, 200, 1, p), "id") for p in (1, 7))
    assert sorted(one.collect()) == sorted(many.collect())
    assert {r["fold"] for r in one.collect()} == set(range(5))
    share = P.holdout(spark.range(5000), "id").agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert share == pytest.approx(0.2, abs=0.02)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 1.0, 9.99, 10.0, None, float("nan")]], "v double")
    assert sorted((r["bin"], r["n"]) for r in S.histogram(df, "v", 10).collect()) == [
        (0, 1), (1, 1), (9, 2)]
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [(r["bin"], r["n"]) for r in S.histogram(same, "v", 10).collect()] == [(0, 2)]


def test_cohorts_put_missing_last(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, 5.0), (4, 3.0)], "k bigint, m double")
    out = [(r["k"], r["rank"]) for r in S.cohorts(df, "m", "k", 2).collect()]
    assert out == [(3, "most"), (1, "most"), (2, "least"), (4, "least")]


def test_joins_on_text(spark):
    left = spark.createDataFrame([(" u\n", 1), (None, 2), ("w", 3)], "url string, a int")
    right = spark.createDataFrame([("u", 7), (None, 8), ("u ", 9)], "url string, b int")
    assert sorted((r["a"], r["b"]) for r in S.join_on_text(left, right, "url").collect()) == [
        (1, 7), (1, 9)]
    joined = S.join_on_text(left, right, "url", null_as_text=True)
    assert sorted((r["a"], r["b"]) for r in joined.collect()) == [(1, 7), (1, 9), (2, 8)]
    assert sorted(r["a"] for r in S.unmatched(left, right, "url").collect()) == [2, 3]


def test_drop_incomplete(spark):
    rows = [(1.0, "x"), (float("nan"), "x"), (2.0, ""), (None, "y"), (float("inf"), "y")]
    df = spark.createDataFrame(rows, "v double, s string")
    assert len(S.drop_incomplete(df).collect()) == 2
    assert len(S.drop_incomplete(df, csv_parity=True).collect()) == 1
    assert len(S.drop_incomplete(df, columns=["s"]).collect()) == 5


def test_tiles_equal_one_matrix(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame(rng.normal(size=(300, 90)) @ rng.normal(size=(90, 90)), columns=[f"c{i}" for i in range(90)])
    data.iloc[::7, 3] = np.nan
    df = spark.createDataFrame(data).repartition(3)
    want = data.corr()
    rows = corr_matrix(df, list(data), tile=20).collect()
    assert len(rows) == 90 * 89 // 2
    for r in rows:
        assert r["r"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-9)


def test_many_columns_in_tiles(spark):
    """Pairs out of 2,000 columns; a task holds matrices of two blocks only."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 2000))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").select(
        *[F.get("x", F.lit(i)).alias(f"c{i}") for i in range(2000)])
    names = [f"c{i}" for i in rng.choice(2000, 12, replace=False)]
    from rostrum.operators.correlate import correlations
    pairs = [(a, b) for a in names for b in names if a < b]
    rows = correlations(df, df.columns, pairs).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        i, j = int(r["a"][1:]), int(r["b"][1:])
        assert r["r"] == pytest.approx(np.corrcoef(x[:, i], x[:, j])[0, 1], abs=1e-9)


def test_sketched_percentiles_merge(spark):
    from rostrum.operators.order_stats import described_sketches, merge_sketches, quantile_sketches
    rng = np.random.default_rng(7)
    groups = {"hot": rng.lognormal(size=200_000), "few": np.array([1.0, 2.0, 4.0]), None: rng.normal(size=500)}
    df = spark.createDataFrame([(k, float(v), i % 3) for k, g in groups.items() for i, v in enumerate(g)] + [
        ("bad", float("nan"), 0), ("bad", 1.0, 1)], "k string, v double, day int")
    parts = [quantile_sketches(df.where(f"day = {d}"), ["k"], "v") for d in range(3)]
    merged = merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["k"])
    once = {r["k"]: r for r in described_sketches(quantile_sketches(df, ["k"], "v"), ["k"]).collect()}
    exact = {r["k"]: r for r in describe(df, ["k"], "v").collect()}
    got = {r["k"]: r for r in described_sketches(merged, ["k"]).collect()}
    assert set(got) == set(exact) == {*groups, "bad"} and got["bad"]["p10"] is None and got["bad"]["n"] == 2
    for k, g in groups.items():
        assert got[k]["n"] == len(g)
        for c in ("mean", "std"):
            assert got[k][c] == pytest.approx(exact[k][c], rel=1e-9) == pytest.approx(once[k][c], rel=1e-9)
        for q, c in ((0.1, "p10"), (0.9, "p90")):
            for r in (got[k], once[k]):
                # The share of values up to the one told.
                assert np.mean(g < r[c]) - 0.01 <= q <= np.mean(g <= r[c]) + 0.01


def test_most_common_equals_a_full_count(spark):
    rng = np.random.default_rng(8)
    skewed = [int(v) for v in rng.zipf(1.3, 30_000) % 100_000] + [None] * 900
    even = [i % 5000 for i in range(30_000)]
    for values in (skewed, even, [1, 1, None], [], [None] * 5):
        df = spark.createDataFrame([(v,) for v in values], "v int")
        for tracked in (64, 1 << 14):
            got = [tuple(r) for r in S.most_common(df, "v", 10, tracked).collect()]
            assert got == [tuple(r) for r in S.value_counts(df, "v").limit(10).collect()]


def test_selection_is_counted_on_the_way(spark, tmp_path):
    from pyspark.sql import Observation
    from rostrum.plans.targets import select_talks
    df = spark.createDataFrame(
        [(1_200_000_000, 1), (1_200_000_000, 2), (0, 1), (0, 2), (None, 1), (1_200_000_000, None)],
        "film_date long, num_speaker int")
    counted = Observation("talks")
    out = select_talks(df, (2007, 2009), counted=counted)
    out.write.parquet(str(tmp_path / "t"))
    assert counted.get == {"read": 6, "selected": 1, "other_year": 3, "other_speakers": 2}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 == select_talks(df, (2007, 2009)).count()
