"""Plans of what is read from files and written to them."""

import pytest
from pyspark.sql import functions as F

from rostrum.bindings import files, reports
from rostrum.plans import analysis
from rostrum.plans.features import feature_table
from rostrum.session import landing, until_exit
from rostrum.sources import tables
from rostrum.sources.results import explode_predictions

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def without_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_tables_join_without_a_shuffle(spark, without_broadcasts):
    given = files.bucketed_tables(spark, SMALL)
    for df in feature_table(*given, "talk"):
        said = plan(df)
        assert "SortMergeJoin" in said and "Exchange" not in said
        assert said.count(f"SelectedBucketsCount: {files.BUCKETS} out of {files.BUCKETS}") >= 3 or "Bucketed: true" in said
    loose = [df.select("*").repartition(3) for df in given]
    want = [sorted(map(tuple, df.collect()), key=str) for df in feature_table(*loose, "talk")]
    assert [sorted(map(tuple, df.collect()), key=str) for df in feature_table(*given, "talk")] == want


def test_another_session_opens_bucketed_tables(spark, without_broadcasts):
    path = landing(spark, "numbers")
    rows = spark.range(500).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"), F.array("id").alias("x"))
    tables.write_bucketed(rows, path, "rostrum_numbers", "k", 4)
    until_exit(spark, path)
    spark.sql("drop table rostrum_numbers")
    other = tables.open_bucketed(spark.newSession(), path, "rostrum_numbers", "k", 4)
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, rows.collect()))
    assert "Exchange" not in plan(other.groupBy("k").agg(F.sum("v")))


def test_result_documents_are_parsed_once(spark):
    df = spark.createDataFrame([("a", '{"r":[]}')], "k string, d string")
    rows = explode_predictions(df, "k", "d")
    parsed = rows._jdf.queryExecution().optimizedPlan().toString()
    # The map of lists, used by itself; the other two are only reached where it is NULL.
    assert parsed.count("from_json(MapType(StringType,ArrayType") == 1 and "coalesce(" in parsed


def test_reports_read_their_table_once_for_all_columns(spark):
    items = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    one, all_ = (plan(analysis.target_histograms(items, c)).count("FileScan parquet")
                 for c in (reports.PRICES[:1], reports.PRICES))
    assert one == all_ == 2  # ends and counts
    users = files.table(spark, SMALL, "events").groupBy("user_id").agg(F.array(F.struct(
        F.lit("a").alias("name"), F.count("*").alias("count"))).alias("ratings"))
    assert plan(analysis.rating_tops(users, ["a", "b", "c", "d"], k=2)).count("FileScan parquet") == 1


def test_histograms_of_awkward_columns(spark):
    df = spark.createDataFrame(
        [(1.0, None, 5, float("nan")), (2.0, None, 5, float("inf")), (4.0, None, None, 1.0)],
        "a double, none double, same int, odd double")
    got = {(r["target"], r["bin"]): r["n"] for r in analysis.target_histograms(df, ["a", "none", "same", "odd"], 3).collect()}
    assert got == {("a", 0): 1, ("a", 1): 1, ("a", 2): 1, ("same", 0): 2, ("odd", 0): 1}
    assert analysis.target_histograms(df.where("false"), ["a"]).count() == 0


def test_csv_keeps_blanks_at_the_ends(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.export_csv(spark.createDataFrame([("u", " a \n ")], "url string, embeddings string"), path)
    assert tables._read_csv(spark, path, "url string, embeddings string").first()["embeddings"] == " a \n "
