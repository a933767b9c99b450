"""Utterances, posterior and gap statistics, feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rostrum.bindings.registry import query, rounded, table
from rostrum.operators import utterances as U
from rostrum.operators.order_stats import describe
from rostrum.plans.features import feature_table, measure_columns, pivot_measures
from rostrum.plans.features import talk_features as summarise
from rostrum.sources.results import explode_predictions

ITEM_TASKS = {"A": ("F", "O"), "N": ("F", "O"), "R": ("F", "O")}


def item_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as predictions: supplier = talk, order = utterance, flag = task."""
    return table(spark, folder, "lineitem").select(
        "l_suppkey", F.col("l_orderkey").alias("id"),
        F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
                 "l_linestatus").alias("pos"),
        F.col("l_quantity").alias("st"), (F.col("l_quantity") + F.col("l_tax")).alias("et"),
        F.col("l_returnflag").alias("task"),
        F.array(F.struct(
            F.col("l_linestatus").alias("label"), F.col("l_discount").alias("posterior")
        )).alias("prediction"),
        F.lit(None).cast("array<double>").alias("vector"), F.lit(False).alias("bad"),
    )


def item_stats(spark: SparkSession, folder: str) -> DataFrame:
    utts = U.utterances(item_predictions(spark, folder), "l_suppkey", ITEM_TASKS)
    return describe(U.label_values(utts, "l_suppkey", ITEM_TASKS), ["l_suppkey", "measure"], "value")


SQL_ITEM_LAST = """
with ranked as (
  select *, row_number() over (
    partition by l_suppkey, l_orderkey, l_returnflag
    order by l_linenumber desc, l_partkey desc, l_quantity desc, l_extendedprice desc,
             l_discount desc, l_linestatus desc
  ) as k from lineitem
), stats as (
  select l_suppkey, l_returnflag || '_' || l_linestatus as measure, count(*) as n,
         avg(l_discount) as mean, stddev_pop(l_discount) as std,
         quantile_cont(l_discount, 0.9) as p90
  from ranked where k = 1 group by 1, 2
)"""


@query(f"""{SQL_ITEM_LAST}
select l_suppkey, measure, n, round(mean, 9) as mean, round(std, 9) as std,
       round(p90, 9) as p90
from stats""")
def posterior_stats(spark: SparkSession, folder: str) -> DataFrame:
    return item_stats(spark, folder).select(
        "l_suppkey", "measure", "n", *[rounded(c, 9).alias(c) for c in ("mean", "std", "p90")]
    )


ITEM_COLUMNS = {n: ms for n, ms in measure_columns(ITEM_TASKS).items() if ms[0] not in
                ("pauses", "turn_durations")}


@query(f"""{SQL_ITEM_LAST}
select l_suppkey, {', '.join(
    f"round(max(case when measure = '{m}' then {s} end), 9) as {name}"
    for name, (m, s) in ITEM_COLUMNS.items())}
from stats group by 1""")
def posterior_columns(spark: SparkSession, folder: str) -> DataFrame:
    wide = pivot_measures(item_stats(spark, folder), "l_suppkey", ITEM_TASKS, list(ITEM_COLUMNS))
    return wide.select("l_suppkey", *[rounded(c, 9).alias(c) for c in ITEM_COLUMNS])


def since_2024(c: str) -> Column:
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, F.col(c)) / F.lit(1000000.0)


SQL_START = "(epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1000000.0::double"


def event_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as an utterance of its user."""
    return table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("ord"), since_2024("ts").alias("st"),
        (since_2024("ts") + F.col("value")).alias("et"),
    )


SQL_GAPS = f"""
with turns as (
  select user_id, event_id, {SQL_START} as st, {SQL_START} + value as et from events
), gaps as (
  select user_id, et - st as turn,
         st - lag(et) over (partition by user_id order by event_id) as pause
  from turns
)"""


def _gap_sql(c: str) -> str:
    return f"""{SQL_GAPS}
select user_id, count({c}) as n, round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as std,
       round(quantile_cont({c}, 0.1), 4) as p10, round(quantile_cont({c}, 0.9), 4) as p90
from gaps where {c} is not null group by 1"""


def _gap_stats(measures: DataFrame) -> DataFrame:
    return describe(measures, ["user_id"], "value").select(
        "user_id", "n", *[rounded(c, 4).alias(c) for c in ("mean", "std", "p10", "p90")]
    )


@query(_gap_sql("pause"))
def pause_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _gap_stats(U.pauses(event_turns(spark, folder), "user_id"))


@query(_gap_sql("turn"))
def turn_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _gap_stats(U.turn_durations(event_turns(spark, folder), "user_id"))


@query("""
select l_returnflag, l_linestatus, count(*) as n, count(nullif(l_tax, 0)) as good,
       round(sum(l_discount), 4) as posterior, round(sum(l_quantity), 4) as first_value
from lineitem group by 1, 2""")
def result_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines written as result documents and read back.

    Numbers stand as text in some fields; a zero tax becomes text that is no number.
    """
    end = F.when(F.col("l_tax") == 0, "none").otherwise(F.col("l_tax").cast("string"))
    document = F.to_json(F.create_map(F.lit("result"), F.array(F.struct(
        F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("startTime"),
        end.alias("endTime"), F.lit("features").alias("task"),
        F.array(F.struct(
            F.col("l_linestatus").alias("label"), F.col("l_discount").alias("posterior")
        )).alias("prediction"),
        F.to_json(F.array("l_quantity", "l_discount")).alias("embedding"),
    ))))
    documents = table(spark, folder, "lineitem").select(
        F.struct("l_returnflag", "l_linestatus").alias("key"), document.alias("document")
    )
    rows = explode_predictions(documents, "key", "document")
    return rows.groupBy("key").agg(
        F.count("*").alias("n"), F.count("et").alias("good"),
        rounded(F.sum(F.get("prediction", F.lit(0))["posterior"]), 4).alias("posterior"),
        rounded(F.sum(F.get("vector", F.lit(0))), 4).alias("first_value"),
    ).select("key.*", "n", "good", "posterior", "first_value")


@query("""
with given as (
  select o_orderkey as talk, o_orderkey % 4 as kind, count(l_orderkey) as lines,
         round(sum(l_quantity), 4) as spoken, o_orderkey % 4 = 1 and count(l_orderkey) > 0 as bare
  from orders left join lineitem on l_orderkey = o_orderkey group by 1
)
select talk, case kind when 2 then 1 else lines end as n, case when kind <> 2 then spoken end as spoken,
       kind = 2 as broken, coalesce(bare, false) as bare
from given where kind = 2 or lines > 0""")
def result_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of orders: several predictions each, a second key that is no list, lists
    without predictions, and documents that hold no list at all."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct(
        F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("startTime"), F.lit("x").alias("task"),
        F.when(F.col("l_orderkey") % 4 != 1, F.array(F.struct(
            F.col("l_linestatus").alias("label"), F.col("l_discount").alias("posterior")
        ))).alias("prediction"),
    ).alias("line")).groupBy("k").agg(F.collect_list("line").alias("lines"))
    listed = F.to_json(F.struct(F.coalesce("lines", F.array()).alias("result"), F.lit("1.2").alias("version")))
    documents = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("k"), "left").select(
        F.col("o_orderkey").alias("talk"),
        F.when(F.col("o_orderkey") % 4 == 2, '{"result": "none"}').otherwise(listed).alias("document"),
    )
    return explode_predictions(documents, "talk", "document").groupBy("talk").agg(
        F.count("*").alias("n"), rounded(F.sum("st"), 4).alias("spoken"),
        F.max(F.col("pos").isNull()).alias("broken"),
        F.max(F.col("pos").isNotNull() & F.col("prediction").isNull()).alias("bare"),
    )


EVENT_TASKS = {t: ("low", "high") for t in ("click", "view", "purchase")}


def event_predictions(spark: SparkSession, folder: str, by_day: bool = False) -> DataFrame:
    """Events as predictions of their user (or of a user's day).

    The number in `props` names the utterance, so some are spoken to twice; errors
    carry the vectors; sign-ups are a task outside the vocabulary. The label is
    listed twice, and the second value counts.
    """
    value = F.col("value")
    label = F.when(value > 20, "high").otherwise("low").alias("label")
    key = F.col("user_id")
    if by_day:
        key = key * 100 + F.floor(since_2024("ts") / 86400)
    is_vector = F.col("event_type") == "error"
    return table(spark, folder, "events").select(
        key.alias("talk"), F.col("event_id").alias("pos"),
        F.regexp_extract("props", r"\d+", 0).alias("id"),
        since_2024("ts").alias("st"), (since_2024("ts") + value).alias("et"),
        F.when(is_vector, "features").otherwise(F.col("event_type")).alias("task"),
        F.array(
            F.struct(label, F.lit(0.0).alias("posterior")),
            F.struct(label, (value / 487).alias("posterior")),
        ).alias("prediction"),
        F.when(is_vector, F.array(value, value * value / 100, F.lit(1.0))).alias("vector"),
        F.lit(False).alias("bad"),
    )


def _event_features_sql(key: str) -> str:
    tasks = ", ".join(
        f"arg_max(value, event_id) filter (where event_type = '{t}') as {t}" for t in EVENT_TASKS
    )
    labels = " union all ".join(
        f"select talk, '{t}_' || case when {t} > 20 then 'high' else 'low' end as measure, "
        f"{t} / 487 as value from utts where {t} is not null"
        for t in EVENT_TASKS
    )
    named = measure_columns(EVENT_TASKS)
    wide = ", ".join(
        f"max(case when measure = '{m}' then {s} end) as \"{name}\""
        for name, (m, s) in named.items()
    )
    dims = {0: "error", 1: "error * error / 100", 2: "1.0"}
    means = ", ".join(f"sum((et - st) * {e}) / sum(et - st) as m{k}" for k, e in dims.items())
    stds = ", ".join(
        f"sqrt(greatest(sum((et - st) * ({e} - m{k}) * ({e} - m{k})) / sum(et - st), 0)) as s{k}"
        for k, e in dims.items()
    )
    return f"""
with utts as (
  select {key} as talk, regexp_extract(props, '\\d+') as id, min(event_id) as ord,
         arg_min({SQL_START}, event_id) as st, arg_min({SQL_START} + value, event_id) as et,
         {tasks}, arg_max(value, event_id) filter (where event_type = 'error') as error
  from events group by 1, 2
), measures as (
  {labels}
  union all select talk, 'turn_durations', et - st from utts
  union all select talk, 'pauses', st - lag(et) over (partition by talk order by ord) from utts
), stats as (
  select talk, measure, avg(value) as mean, stddev_pop(value) as std,
         quantile_cont(value, 0.1) as p10, quantile_cont(value, 0.9) as p90
  from measures where value is not null group by 1, 2
), wide as (
  select talk, {wide} from stats group by 1
), means as (
  select talk, {means} from utts where error is not null group by 1
), vectors as (
  select talk, {', '.join(f'any_value(m{k}) as m{k}' for k in dims)}, {stds}
  from utts join means using (talk) where error is not null group by 1
), problems as (
  select talk, case when count(*) < 2 then 'lt2_utterances'
                    when coalesce(sum(et - st) filter (where error is not null), 0) = 0
                    then 'no_embedding' end as reason
  from utts group by 1
)"""


EVENT_COLUMNS = list(measure_columns(EVENT_TASKS))


def digits(column: str) -> int:
    """Gaps between events are days of seconds, posteriors below one."""
    return 3 if column.startswith("pauses") else 6


SQL_EVENT_FEATURES = _event_features_sql("user_id")


@query(f"""{SQL_EVENT_FEATURES}
select w.talk, {', '.join(f'round(w."{c}", {digits(c)}) as "{c}"' for c in EVENT_COLUMNS)},
       {', '.join(f'round(m{k}, 6) as mean_{k}, round(s{k}, 5) as std_{k}' for k in range(3))}
from wide w join vectors using (talk) join problems p on p.talk = w.talk and reason is null""")
def talk_features(spark: SparkSession, folder: str) -> DataFrame:
    features, _ = summarise(event_predictions(spark, folder), "talk", EVENT_TASKS)
    return features.select(
        "talk", *[rounded(c, digits(c)).alias(c) for c in EVENT_COLUMNS],
        *[rounded(F.get("features_embedding_mean", F.lit(k))).alias(f"mean_{k}") for k in range(3)],
        *[rounded(F.get("features_embedding_std", F.lit(k)), 5).alias(f"std_{k}") for k in range(3)],
    )


@query(_event_features_sql(
    f"user_id * 100 + floor({SQL_START} / 86400)::bigint"
) + "select talk, reason from problems where reason is not null")
def excluded_talks(spark: SparkSession, folder: str) -> DataFrame:
    _, excluded = summarise(event_predictions(spark, folder, by_day=True), "talk", EVENT_TASKS)
    return excluded


def customer_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Customers as talks, events as their results, embeddings as their MFCCs."""
    features, excluded = summarise(event_predictions(spark, folder), "talk", EVENT_TASKS)
    talks = table(spark, folder, "customer").select(F.col("c_custkey").alias("talk"), "c_mktsegment")
    vector = F.col("embedding").cast("array<double>")
    # Even keys only: every other customer has no MFCC.
    mfcc = table(spark, folder, "embeddings").select(
        (F.col("vec_id") * 2).alias("talk"), vector.alias("mfccs_mean"), vector.alias("mfccs_std")
    )
    return feature_table(talks, features, excluded, mfcc, "talk")


@query(f"""{SQL_EVENT_FEATURES}
select w.talk, c_mktsegment, round(pauses_mean, 3) as pauses_mean,
       round(click_low_90p, 6) as click_low_90p, embedding[1]::double as first_mfcc
from wide w join problems p on p.talk = w.talk and reason is null
join vectors v on v.talk = w.talk
join customer on c_custkey = w.talk join embeddings on vec_id * 2 = w.talk""")
def talk_table(spark: SparkSession, folder: str) -> DataFrame:
    joined, _ = customer_tables(spark, folder)
    return joined.select(
        "talk", "c_mktsegment", rounded("pauses_mean", 3).alias("pauses_mean"),
        rounded("click_low_90p").alias("click_low_90p"),
        F.get("mfccs_mean", F.lit(0)).alias("first_mfcc"),
    )


@query(f"""{SQL_EVENT_FEATURES}
select talk, reason from (
  select c_custkey as talk, coalesce(p.reason, case when p.talk is null then 'no_result'
                                      when vec_id is null then 'no_mfcc' end) as reason
  from customer left join problems p on p.talk = c_custkey
  left join embeddings on vec_id * 2 = c_custkey
) where reason is not null""")
def talk_table_excluded(spark: SparkSession, folder: str) -> DataFrame:
    _, excluded = customer_tables(spark, folder)
    return excluded
