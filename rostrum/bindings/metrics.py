"""Metrics of a fixed pseudo-prediction: the price's level guessed from the quantity's.

Priority plays the target, order status the feature set, and the fold comes from
the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.bindings.registry import query, rounded
from rostrum.bindings.targets import SQL_ALL_LEVELS, order_levels
from rostrum.operators import metrics as M
from rostrum.operators.models import stratified_baseline
from rostrum.operators.positions import hash_folds
from rostrum.plans.analysis import metric_scores, score_report
from rostrum.vocab import LEVELS

RUN = ["target", "type", "fold"]
TYPES = {"F": "Embeddings", "O": "MFCC", "P": "Text"}
TARGETS = {"1-URGENT": "views", "2-HIGH": "comments_per_view"}


def guesses(spark: SparkSession, folder: str) -> DataFrame:
    z = F.col("comments_z")
    # Every order with lines has both levels; the raw column reaches the join.
    rows = hash_folds(order_levels(spark, folder, years=None), "o_orderkey").where(
        F.col("comments").isNotNull()
    )
    target, kind = F.col("o_orderpriority"), F.col("o_orderstatus")
    return rows.select(
        F.coalesce(*[F.when(target == k, v) for k, v in TARGETS.items()], target).alias("target"),
        F.coalesce(*[F.when(kind == k, v) for k, v in TYPES.items()]).alias("type"),
        "fold", F.col("o_orderkey").alias("key"),
        F.col("views_level").alias("y"), F.col("comments_level").alias("p"),
        (-z).alias("low"), (-F.abs(z)).alias("medium"), z.alias("high"),
    )


SQL_FOLD = "('0x' || substr(md5({}::varchar || '|42'), 1, 8))::bigint % 5"
SQL_GUESSES = f"""{SQL_ALL_LEVELS}, guesses as (
  select case o_orderpriority when '1-URGENT' then 'views' when '2-HIGH' then 'comments_per_view'
         else o_orderpriority end as target,
         case o_orderstatus when 'F' then 'Embeddings' when 'O' then 'MFCC' when 'P' then 'Text'
         end as type,
         {SQL_FOLD.format('o_orderkey')} as fold, o_orderkey as key,
         views_level as y, comments_level as p, comments_z as z
  from levels where views_level is not null and comments_level is not null
), labels as (select unnest(['low', 'medium', 'high']) as class)"""
SQL_CLASSES = f"""{SQL_GUESSES}, tallies as (
  select target, type, fold, class, count(*) filter (where y = class and p = class) as hit,
         count(*) filter (where y = class) as support, count(*) filter (where p = class) as said
  from guesses, labels group by all
), classes as (
  select target, type, fold, class, coalesce(hit / nullif(said, 0), 0) as precision,
         coalesce(hit / nullif(support, 0), 0) as recall,
         coalesce(2 * hit / nullif(said + support, 0), 0) as f1, support,
         support + said > 0 as seen
  from tallies
), ranked as (
  select target, type, fold, class, y,
         rank() over (partition by target, type, fold, class order by s)
         + (count(*) over (partition by target, type, fold, class, s) - 1) / 2 as place
  from (select *, case class when 'low' then -z when 'high' then z else -abs(z) end as s
        from guesses, labels)
), areas as (
  select target, type, fold, class,
         (sum(place) filter (where y = class)
          - count(*) filter (where y = class) * (count(*) filter (where y = class) + 1) / 2)
         / nullif(count(*) filter (where y = class) * count(*) filter (where y <> class), 0) as auc
  from ranked group by all
), runs as (
  select target, type, fold, coalesce(
           count(*) filter (where y <> 'medium' and p <> 'medium' and y = p)
           / nullif(count(*) filter (where y <> 'medium' and p <> 'medium'), 0), 0
         ) as extreme_errors, avg((y = p)::int) as accuracy
  from guesses group by all
), overall as (
  select target, type, fold, avg(f1) filter (where seen) as f1_macro,
         sum(f1 * support) / sum(support) as f1_weighted
  from classes group by all
), scores as (
  select target, type, metric, avg(value) as value from (
    select target, type, 'precision_' || class as metric, precision as value from classes
    union all select target, type, 'recall_' || class, recall from classes
    union all select target, type, 'auc_' || class, auc from areas
    union all select target, type, 'f1_macro', f1_macro from overall
    union all select target, type, 'f1_weighted', f1_weighted from overall
    union all select target, type, 'extreme_errors', extreme_errors from runs
  ) group by all
)"""


@query(f"""{SQL_GUESSES}
select y.class as y, p.class as p, count(key) as n
from labels y cross join labels p
left join guesses g on g.y = y.class and g.p = p.class and fold = 0
group by 1, 2""")
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    """The first fold's table."""
    first = guesses(spark, folder).where(F.col("fold") == 0)
    return M.confusion(first, ["fold"]).drop("fold")


@query(f"""{SQL_GUESSES}
select r.target, r.type, y.class as y, p.class as p, count(key) as n
from (select distinct target, type from guesses where fold = 0) r
cross join labels y cross join labels p
left join guesses g on g.target = r.target and g.type = r.type and g.y = y.class and g.p = p.class
  and fold = 0
group by all""")
def confusion_by_run(spark: SparkSession, folder: str) -> DataFrame:
    """The first fold's table of every target and type."""
    return M.confusion(guesses(spark, folder).where(F.col("fold") == 0), ["target", "type"])


@query(f"""{SQL_CLASSES}
select target, type, fold, class, round(precision, 6) as precision, round(recall, 6) as recall,
       round(f1, 6) as f1, support, seen
from classes""")
def class_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = M.class_scores(guesses(spark, folder), RUN)
    return out.withColumns({c: rounded(c) for c in ("precision", "recall", "f1")})


@query(f"{SQL_CLASSES} select target, type, fold, class, round(auc, 6) as auc from areas")
def auc_ovr(spark: SparkSession, folder: str) -> DataFrame:
    return M.class_auc(guesses(spark, folder), RUN).withColumn("auc", rounded("auc"))


@query(f"""{SQL_CLASSES}
select target, type, fold, round(f1_macro, 6) as f1_macro, round(f1_weighted, 6) as f1_weighted,
       round(accuracy, 6) as accuracy, round(extreme_errors, 6) as extreme_errors
from overall join runs using (target, type, fold)""")
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy, macro and weighted F1, and agreement on the extremes."""
    out = M.run_scores(guesses(spark, folder), RUN)
    return out.withColumns({
        c: rounded(c) for c in ("f1_macro", "f1_weighted", "accuracy", "extreme_errors")
    })


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return M.score_table(guesses(spark, folder), ["target", "type"], "fold")


@query(f"{SQL_CLASSES} select target, type, metric, round(value, 6) as value from scores")
def score_long(spark: SparkSession, folder: str) -> DataFrame:
    return scores(spark, folder).withColumn("value", rounded("value"))


@query(f"""{SQL_CLASSES}
select target, type, metric, round(value, 6) as value from scores where metric = 'f1_macro'
order by value, target, type""")
def scores_of_metric(spark: SparkSession, folder: str) -> DataFrame:
    return metric_scores(scores(spark, folder), "f1_macro").withColumn("value", rounded("value"))


def _report_sql(inside: str) -> str:
    return f"""{SQL_CLASSES}
select target, case type when 'Embeddings' then 'Behavioral Embeddings' else type end as type,
       metric, round(value, 6) as value
from scores where metric = 'auc_high' and type in ('Embeddings', 'MFCC')
  and {inside} (target in ('views', 'comments_per_view'))
order by value, target, type"""


@query(_report_sql(""))
def popularity_report(spark: SparkSession, folder: str) -> DataFrame:
    types = ["MFCC", "Behavioral Embeddings"]
    report = score_report(scores(spark, folder), "auc_high", types, popularity=True)
    return report.withColumn("value", rounded("value"))


@query(_report_sql("not"))
def rating_report(spark: SparkSession, folder: str) -> DataFrame:
    types = ["MFCC", "Behavioral Embeddings"]
    report = score_report(scores(spark, folder), "auc_high", types, popularity=False)
    return report.withColumn("value", rounded("value"))


@query(f"""{SQL_GUESSES}, counts as (
  select f.fold, class, count(*) filter (where y = class) as n
  from (select distinct fold from guesses) f join guesses g on g.fold <> f.fold, labels
  group by 1, 2
), upto as (
  select fold, class, sum(n) over (
    partition by fold order by case class when 'low' then 0 when 'medium' then 1 else 2 end
  ) / sum(n) over (partition by fold) as u from counts
), drawn as (
  select key, y, g.fold, count(*) filter (where u <= ('0x' || substr(md5(key::varchar || '|42'),
         1, 8))::bigint / 4294967296.0::double) as place
  from guesses g join upto using (fold) group by all
)
select key, y, fold, ['low', 'medium', 'high'][place + 1] as p from drawn""")
def baseline(spark: SparkSession, folder: str) -> DataFrame:
    rows = guesses(spark, folder).select("key", "y", "fold")
    return stratified_baseline(rows, LEVELS).select("key", "y", "fold", "p")
