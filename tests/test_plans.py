"""What the scans and the top-k reports do; `test_oracle` looks at every plan."""

import re

from pyspark.sql import functions as F

from rostrum import bindings
from rostrum.plans.targets import select_talks

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    df = bindings.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_rows_need_no_full_sort(spark):
    for name in ("top_100", "bottom_100"):
        assert "TakeOrderedAndProject" in plan(spark, name)


def test_scans_read_only_what_is_used(spark):
    schema = re.findall(r"ReadSchema: (\S+)", plan(spark, "pause_stats"))
    assert all(s.startswith("struct<") for s in schema)
    schema = re.findall(r"ReadSchema: (\S+)", plan(spark, "value_counts"))
    assert schema == ["struct<event_type:string>"]


def test_the_selection_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "talks")
    spark.range(10).select(
        (F.col("id") * 40_000_000).alias("film_date"), F.lit(1).alias("num_speaker")
    ).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = select_talks(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text)[1]
    assert "GreaterThanOrEqual(film_date" in pushed and "LessThan(film_date" in pushed and "EqualTo(num_speaker" in pushed
