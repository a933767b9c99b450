"""Popularity and rating targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.bindings.registry import query, rounded, sql_level, sql_z, table
from rostrum.functions import ratings as R
from rostrum.functions.numeric import band, log_offset
from rostrum.operators.summaries import top_contains
from rostrum.operators.zscore import zscore
from rostrum.plans.targets import (
    popularity_columns, rating_targets, select_talks, with_years,
)

EVENT_TYPES = ("click", "view", "purchase", "signup", "error")
POSITIVE, NEGATIVE = EVENT_TYPES[:4], EVENT_TYPES[4:]


def order_talks(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as talks: the price is the views, the ordered quantity the comments."""
    items = (
        table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum("l_quantity").alias("comments"))
    )
    epoch = F.timestamp_diff(
        "SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate")
    )
    return (
        table(spark, folder, "orders")
        .select(
            "o_orderkey", "o_orderstatus", "o_orderpriority",
            F.col("o_totalprice").alias("views"), epoch.alias("film_date"),
            (epoch + 86400 * 45).alias("published_date"),
            F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("num_speaker"),
        )
        .join(items, "o_orderkey", "left")
    )


def order_levels(
    spark: SparkSession, folder: str, years: tuple[int, int] | None = (1996, 2000)
) -> DataFrame:
    """Z-scores and levels of the orders of 1996 to 2000, or of all."""
    talks = with_years(order_talks(spark, folder))
    if years:
        talks = talks.where(F.col("film_year").between(*years))
    scored = zscore(popularity_columns(talks), {
        "log_views": "views_z", "log_comments": "comments_z", "log_comments_per_view": "cpv_z",
    })
    return scored.withColumns({
        "views_level": band("views_z"), "comments_level": band("comments_z"),
        "cpv_level": band("cpv_z"),
    })


SQL_ORDER_TALKS = """
with items as (
  select l_orderkey, sum(l_quantity) as comments from lineitem group by 1
), talks as (
  select o_orderkey, o_orderstatus, o_orderpriority, o_totalprice as views, comments,
         o_orderdate as film_date, o_orderdate + interval 45 day as published_date
  from orders left join items on l_orderkey = o_orderkey
)"""
def _sql_levels(where: str) -> str:
    return f"""{SQL_ORDER_TALKS},
scored as (
  select *, {sql_z('ln(views)')} as views_z, {sql_z('ln(comments)')} as comments_z,
         {sql_z('ln(comments / views)')} as cpv_z
  from talks {where}
), levels as (
  select *, {sql_level('views_z')} as views_level, {sql_level('comments_z')} as comments_level,
         {sql_level('cpv_z')} as cpv_level
  from scored
)"""


SQL_ORDER_LEVELS = _sql_levels("where year(film_date) between 1996 and 2000")
SQL_ALL_LEVELS = _sql_levels("")


@query(f"""{SQL_ORDER_LEVELS}
select views_level, comments_level, count(*) as n from levels group by 1, 2""")
def popularity_levels(spark: SparkSession, folder: str) -> DataFrame:
    return order_levels(spark, folder).groupBy("views_level", "comments_level").agg(
        F.count("*").alias("n")
    )


@query(f"""{SQL_ORDER_LEVELS}
select o_orderkey, round(views_z, 6) as views_z, round(comments_z, 6) as comments_z,
       round(cpv_z, 6) as cpv_z, views_level, comments_level, cpv_level
from levels""")
def popularity_scores(spark: SparkSession, folder: str) -> DataFrame:
    return order_levels(spark, folder).select(
        "o_orderkey", *[rounded(c).alias(c) for c in ("views_z", "comments_z", "cpv_z")],
        "views_level", "comments_level", "cpv_level",
    )


@query(f"""{SQL_ORDER_TALKS}
select year(film_date)::int as film_year, year(published_date)::int as published_year,
       count(*) as n
from talks where year(film_date) between 1997 and 1999 and o_orderstatus <> 'P'
group by 1, 2""")
def talk_selection(spark: SparkSession, folder: str) -> DataFrame:
    talks = select_talks(with_years(order_talks(spark, folder)), years=(1997, 1999))
    return talks.groupBy("film_year", "published_year").agg(F.count("*").alias("n"))


def user_talks(spark: SparkSession, folder: str) -> DataFrame:
    """Users as talks: the events of each type are the ratings.

    The types are known, so the rating list is five conditional counts.
    """
    counts = table(spark, folder, "events").groupBy("user_id").agg(
        F.sum(F.round(F.col("value") * 100)).cast("bigint").alias("views"),
        F.count(F.when(F.col("value") > 50, 1)).alias("comments"),
        *[F.count(F.when(F.col("event_type") == t, 1)).alias(f"n_{t}") for t in EVENT_TYPES],
    )
    return counts.select("user_id", "views", "comments", F.array(*[
        F.struct(F.lit(t).alias("name"), F.col(f"n_{t}").alias("count")) for t in EVENT_TYPES
    ]).alias("ratings"))


SQL_USER_TALKS = f"""
with talks as (
  select user_id, sum(round(value * 100))::bigint as views,
         count(*) filter (where value > 50) as comments,
         {', '.join(f"count(*) filter (where event_type = '{t}') as n_{t}" for t in EVENT_TYPES)},
         count(*) as total
  from events group by 1
)"""


def _user_targets_sql() -> str:
    """The whole target list in SQL, column by column."""
    logs = {
        "log_views": "ln(nullif(views, 0))",
        "log_comments": "ln(nullif(comments, 0))",
        "log_comments_per_view": "ln(nullif(comments, 0) / views)",
        "log_ratings_views": "ln(total / nullif(views, 0))",
        "log_negative_ratings": "ln(n_error + 0.001)",
        **{f"log_{t}": f"ln(n_{t} / total + 0.001)" for t in EVENT_TYPES},
        **{f"log_{t}_views": f"ln(n_{t} / total * ln(views) + 0.001)" for t in EVENT_TYPES},
    }
    plain = {"views": "views", "comments": "comments", "comments_per_view": "comments / views"}
    measures = {**plain, **logs}
    z = ", ".join(f"{sql_z(e)} as {c}_norm" for c, e in measures.items())
    out = ", ".join(f"round({c}_norm, 6) as {c}_norm" for c in measures)
    levels = ", ".join(f"{sql_level(c + '_norm')} as {c}_norm_cat" for c in logs)
    return f"""{SQL_USER_TALKS}, scored as (select user_id, {z},
      (total - 2 * n_error) / total as sentiment from talks)
    select user_id, {out}, {levels}, round(sentiment, 6) as sentiment from scored"""


@query(_user_targets_sql())
def rating_target_set(spark: SparkSession, folder: str) -> DataFrame:
    out = rating_targets(user_talks(spark, folder), POSITIVE, NEGATIVE)
    z = [c for c in out.columns if c.endswith("_norm")]
    levels = [c for c in out.columns if c.endswith("_norm_cat")]
    return out.select(
        "user_id", *[rounded(c).alias(c) for c in z], *levels,
        rounded("sentiment").alias("sentiment"),
    )


@query(f"""
with x as (select p_partkey, ln(p_retailprice + 0.001) as v from part),
scored as (select p_partkey, {sql_z('v')} as z_sample, {sql_z('v', 'stddev_pop')} as z_population
  from x)
select p_partkey, round(z_sample, 6) as z_sample, round(z_population, 6) as z_population
from scored""")
def zscore_pop_vs_sample(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(
        "p_partkey", log_offset("p_retailprice").alias("v")
    )
    both = zscore(zscore(parts, {"v": "z_sample"}), {"v": "z_population"}, ddof=0)
    return both.select(
        "p_partkey", rounded("z_sample").alias("z_sample"),
        rounded("z_population").alias("z_population"),
    )


@query(f"""{SQL_USER_TALKS}
select user_id, total, n_error as negative,
       {', '.join(f"round(n_{t} / total, 6) as share_{t}" for t in EVENT_TYPES)},
       {', '.join(f"round(n_{t} / total, 6) as {t}" for t in EVENT_TYPES)},
       round(n_click / total * ln(views), 6) as click_views
from talks""")
def ratings_nested(spark: SparkSession, folder: str) -> DataFrame:
    return user_talks(spark, folder).select(
        "user_id", R.total("ratings").alias("total"),
        R.named_total("ratings", NEGATIVE).alias("negative"),
        *[rounded(R.share("ratings", t)).alias(f"share_{t}") for t in EVENT_TYPES],
        *[rounded(c).alias(t) for c, t in zip(R.wide_shares("ratings", EVENT_TYPES), EVENT_TYPES)],
        rounded(R.share("ratings", "click") * F.ln("views")).alias("click_views"),
    )


@query(f"""{SQL_USER_TALKS}
select user_id, round((total - 2 * n_error) / nullif(total, 0), 6) as sentiment from talks""")
def sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return user_talks(spark, folder).select(
        "user_id", rounded(R.sentiment("ratings", POSITIVE, NEGATIVE)).alias("sentiment")
    )


SQL_TOP = f"""{SQL_USER_TALKS}, long as (
  {' union all '.join(
      f"select user_id, '{t}' as name, n_{t} as n, {i} as place from talks"
      for i, t in enumerate(EVENT_TYPES))}
), ranked as (
  select *, row_number() over (partition by user_id order by n desc, place) as k from long
)"""


@query(f"""{SQL_TOP}, flags as (
  select user_id, bool_or(name = 'purchase') as holds from ranked where k <= 2 group by 1
)
select case when holds then 'positive' else 'negative' end as side, count(*) as n
from flags group by 1""")
def top_array_contains(spark: SparkSession, folder: str) -> DataFrame:
    return top_contains(user_talks(spark, folder), "ratings", "purchase", 2)


@query(f"""{SQL_TOP}
select user_id, string_agg(name, ',' order by k) as names from ranked where k <= 3 group by 1""")
def top_array_names(spark: SparkSession, folder: str) -> DataFrame:
    return user_talks(spark, folder).select(
        "user_id", F.array_join(R.top_names("ratings", 3), ",").alias("names")
    )


@query(f"""{SQL_USER_TALKS}
select user_id, total, n_error as negative, round(n_view / total, 6) as share_view
from talks""")
def ratings_text(spark: SparkSession, folder: str) -> DataFrame:
    """The rating list as text with single quotes and an extra key, decoded again."""
    talks = user_talks(spark, folder)
    text = F.concat(F.lit("["), F.array_join(F.transform("ratings", lambda r: F.concat(
        F.lit("{'id': 7, 'name': '"), r["name"], F.lit("', 'count': "),
        r["count"].cast("string"), F.lit("}"),
    )), ", "), F.lit("]"))
    return talks.select("user_id", R.parse_ratings(text).alias("ratings")).select(
        "user_id", R.total("ratings").alias("total"),
        R.named_total("ratings", NEGATIVE).alias("negative"),
        rounded(R.share("ratings", "view")).alias("share_view"),
    )
