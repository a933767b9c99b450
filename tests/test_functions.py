import math
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F

from rostrum.functions import numeric as N, ratings as R, text as X, vectors as V


def values(spark, kind, items, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_band_takes_the_first_closed_range(spark):
    z = [-2.0, -1.0, -0.5, 1.0, 1.5, math.nan, None, math.inf]
    assert values(spark, "double", z, N.band("v")) == [
        "low", "low", "medium", "medium", "high", None, None, None,
    ]


def test_band_strict_stops_and_checks_its_arguments(spark):
    with pytest.raises(Exception, match="no range holds"):
        values(spark, "double", [math.nan], N.band("v", strict=True))
    with pytest.raises(ValueError):
        N.band("v", [(0, 1)], ["a", "b"])
    assert values(spark, "double", [3.0, 7.0], N.band("v", [(0, 5)], ["few"])) == ["few", None]


def test_logs_and_ratios_are_null_where_undefined(spark):
    assert values(spark, "double", [0.0, -1.0, math.e], N.log("v")) == [None, None, 1.0]
    assert values(spark, "double", [0.0], N.log_offset("v")) == [math.log(0.001)]
    assert values(spark, "bigint", [0, 4], N.ratio(F.lit(2), "v")) == [None, 0.5]
    assert values(spark, "double", [math.nan, math.inf, 1.0], N.finite("v")) == [None, None, 1.0]


def test_epoch_year_is_utc_in_any_zone(spark):
    seconds = [0, 1293839999, 1293840000, -1, 1483228799]
    expected = [datetime.fromtimestamp(s, timezone.utc).year for s in seconds]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert values(spark, "bigint", seconds, N.epoch_year("v")) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ordinal_map_flag_and_relabel(spark):
    ages = ["18 - 22", "46 - 65", None, "other"]
    codes = {"18 - 22": 0, "46 - 65": 3}
    assert values(spark, "string", ages, N.ordinal_map("v", codes)) == [0, 3, None, None]
    with pytest.raises(Exception, match="unknown category"):
        values(spark, "string", ages, N.ordinal_map("v", codes, strict=True))
    assert values(spark, "double", [0.5, 0.6, None], N.flag_above("v")) == [0, 1, 0]
    assert values(spark, "string", ["a", "b"], N.relabel("v", "a", "c")) == ["c", "b"]


def test_mask_small(spark):
    assert values(spark, "double", [0.1999, -0.25, None], N.mask_small("v", 0.2)) == [
        "-", "-0.25", None,
    ]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=2, max_size=200))
def test_order_slot_never_falls(spark, items):
    items = sorted(items + [0.0, 5e-324, -5e-324, 1.7e308])
    slots = values(spark, "double", items, N.order_slot("v"))
    assert slots == sorted(slots)


def test_ratings(spark):
    text = "[{'id': 7, 'name': 'Funny', 'count': 30}, {'id': 1, 'name': 'OK', 'count': 10}]"
    twice = "[{'name': 'Funny', 'count': 1}, {'name': 'OK', 'count': 2}, {'name': 'Funny', 'count': 5}]"
    rows = [text, twice, "[]"]
    r = R.parse_ratings("v")
    assert values(spark, "string", rows, R.total(r)) == [40, 8, 0]
    assert values(spark, "string", rows, R.share(r, "Funny")) == [0.75, 0.125, None]
    assert values(spark, "string", rows, R.last_share(r, "Funny")) == [0.75, 0.625, None]
    assert values(spark, "string", rows, R.share(r, "Inspiring")) == [None, None, None]
    assert values(spark, "string", rows, R.sentiment(r)) == [0.5, 0.5, None]
    assert values(spark, "string", rows, R.named_total(r, ["OK"])) == [10, 2, 0]
    assert values(spark, "string", rows, R.top_names(r, 2)) == [
        ["Funny", "OK"], ["Funny", "OK"], [],
    ]
    assert values(spark, "string", rows, F.concat_ws(",", *[
        c.cast("string") for c in R.wide_shares(r, ["OK", "Funny"])
    ])) == ["0.25,0.75", "0.25,0.625", ""]


def test_equal_counts_keep_list_order(spark):
    r = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(3).cast("bigint").alias("count"))
                  for n in ("b", "a", "c")])
    assert values(spark, "int", [0], R.top_names(r, 2)) == [["b", "a"]]


def test_clean_transcript(spark):
    text = "a(b\nc)d(e\rf)g(h(i)j)"
    assert values(spark, "string", [text, "((((", ""], X.clean_transcript("v")) == [
        "a(b\nc)dgj)", "((((", "",
    ]


ODD = [None, "", " a\x1cb c　d \n", "one", " x y\x85", "  \t "]


def test_word_count_is_pythons_split(spark):
    assert values(spark, "string", ODD, X.word_count("v")) == [len((t or "").split()) for t in ODD]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　ab(é", max_size=20),
                min_size=1, max_size=50))
def test_blanks_agree_with_python(spark, items):
    assert values(spark, "string", items, X.word_count("v")) == [len(t.split()) for t in items]
    assert values(spark, "string", items, X.strip("v")) == [t.strip() for t in items]
    assert values(spark, "string", items, X.truncate_tokens("v", 2)) == [
        " ".join(t.split()[:2]) for t in items
    ]


def test_join_key(spark):
    assert values(spark, "string", [" u\n", None], X.join_key("v")) == ["u", None]
    assert values(spark, "string", [None], X.join_key("v", null_as_text=True)) == ["nan"]


def test_vectors(spark):
    assert values(spark, "string", ["[1, -2e-3]", "[]"], V.parse_vector("v")) == [[1.0, -0.002], []]
    rows = spark.createDataFrame([Row(a=1, b=2.0), Row(a=2, b=None)], "a int, b double")
    assert [r[0] for r in rows.select(V.assemble(["a", "b"])).collect()] == [[1.0, 2.0], None]
    both = rows.select(V.concat(F.array("a"), F.array("a", "a"))).first()[0]
    assert both == [1, 1, 1]
