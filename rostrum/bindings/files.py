"""Tables written in the formats of the sources and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.bindings.metrics import SQL_CLASSES, scores
from rostrum.bindings.registry import query, rounded, table
from rostrum.plans.features import feature_table
from rostrum.session import landing, until_exit
from rostrum.sources import tables
from rostrum.sources.results import read_predictions


def landed(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    path = landing(spark, name)
    write(path)
    until_exit(spark, path)
    return path


def talk_csv(spark: SparkSession, folder: str) -> list[str]:
    """Documents as talks in two CSV folders with other column orders. Texts hold line breaks,
    and quotes are put around every word `the`."""
    talks = table(spark, folder, "documents").select(
        F.col("doc_id").alias("views"), F.concat(F.lit("u,"), F.col("doc_id").cast("string")).alias("url"),
        F.regexp_replace("text", r"\bthe\b", '"the"').alias("transcript"),
        F.concat(F.lit("[{'id': 1, 'name': 'Funny', 'count': "), F.col("n_chars").cast("string"),
                 F.lit("}, {'id': 2, 'name': 'OK', 'count': 1}]")).alias("ratings"),
        F.when(F.col("doc_id") % 3 == 0, "nan").otherwise(F.col("n_chars").cast("string")).alias("comments"),
    )
    odd = F.col("views") % 2 == 1
    return [
        landed(spark, "talks", lambda path: tables.export_csv(talks.where(odd), path)),
        landed(spark, "talks", lambda path: tables.export_csv(talks.where(~odd).select(*talks.columns[::-1]), path)),
    ]


@query(r"""
select doc_id as views, 'u,' || doc_id as url, md5(regexp_replace(text, '\bthe\b', '"the"', 'g')) as digest,
       case when doc_id % 3 <> 0 then n_chars end as comments, n_chars + 1 as total
from documents""")
def talk_files(spark: SparkSession, folder: str) -> DataFrame:
    """Talks of CSV files with quoted line breaks, doubled quotes and swapped columns."""
    talks = tables.read_talks(
        spark, talk_csv(spark, folder), "views bigint, url string, transcript string, ratings string, comments bigint"
    )
    return talks.select("views", "url", F.md5("transcript").alias("digest"), "comments", F.aggregate(
        "ratings", F.lit(0).cast("bigint"), lambda total, r: total + r["count"]).alias("total"))


@query("""
select user_id::varchar as talk, event_type as task, count(*) as n, count(*) filter (where event_id % 7 <> 0) as timed,
       round(sum(case when event_id % 7 <> 0 then value end), 4) as spoken, round(sum(value / 2), 4) as posterior,
       round(sum(case when event_type = 'features' or event_type = 'error' then value end), 4) as first
from events group by 1, 2""")
def prediction_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON lines of predictions; every seventh has no number for its beginning."""
    is_vector = F.col("event_type") == "error"
    lines = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("filename"), F.col("event_id").alias("pos"),
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_id") % 7 == 0, "none").otherwise(F.col("value").cast("string")).alias("startTime"),
        F.col("value").alias("endTime"), F.when(is_vector, "features").otherwise(F.col("event_type")).alias("task"),
        F.array(F.struct(F.lit("half").alias("label"), (F.col("value") / 2).alias("posterior"))).alias("prediction"),
        F.when(is_vector, F.to_json(F.array("value", F.lit(1.0)))).alias("embedding"),
    )
    path = landed(spark, "lines", lambda path: lines.write.json(path))
    read = read_predictions(spark, path)
    return read.groupBy(F.col("filename").alias("talk"), F.when(
        F.col("task") == "features", "error").otherwise(F.col("task")).alias("task")
    ).agg(
        F.count("*").alias("n"), F.count("st").alias("timed"), rounded(F.sum("st"), 4).alias("spoken"),
        rounded(F.sum(F.get("prediction", F.lit(0))["posterior"]), 4).alias("posterior"),
        rounded(F.sum(F.get("vector", F.lit(0))), 4).alias("first"),
    )


@query("""
select vec_id::varchar as filename, round(list_sum(embedding::double[]), 5) as mean_sum,
       round(list_sum([x * 2 for x in embedding::double[]]), 5) as std_sum,
       round(list_sum(embedding::double[]), 5) as text_sum, 64 as width
from embeddings""")
def vector_files(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as MFCCs in Parquet and as transcript embeddings in CSV and in Parquet."""
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("filename"), v.alias("mfccs_mean"),
        F.transform(v, lambda x: x * 2).alias("mfccs_std"),
    )
    embeddings = rows.select(F.col("filename").alias("url"), F.col("mfccs_mean").alias("embeddings"))
    mfcc = landed(spark, "mfcc", lambda path: tables.write_table(rows, path))
    text = landed(spark, "embeddings", lambda path: tables.export_csv(embeddings, path))
    typed = landed(spark, "embeddings", lambda path: tables.write_table(embeddings, path))
    both = tables.read_text_embeddings(spark, text, "csv").intersectAll(tables.read_text_embeddings(spark, typed))
    total = lambda c: rounded(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 5)
    return tables.read_mfcc(spark, mfcc).join(both, F.col("filename") == F.col("url")).select(
        "filename", total("mfccs_mean").alias("mean_sum"), total("mfccs_std").alias("std_sum"),
        total("embeddings").alias("text_sum"), F.size("embeddings").alias("width"),
    )


@query(f"{SQL_CLASSES} select target, type, metric, round(value, 6) as value, 2 as n from scores")
def score_files(spark: SparkSession, folder: str) -> DataFrame:
    """The score table in Parquet and in CSV."""
    given = scores(spark, folder)
    typed = landed(spark, "scores", lambda path: tables.write_table(given, path))
    text = landed(spark, "scores", lambda path: tables.export_csv(tables.read_scores(spark, typed), path))
    read = tables.read_scores(spark, typed).unionByName(tables.read_scores(spark, text, "csv"))
    return read.groupBy("target", "type", "metric", rounded("value").alias("value")).agg(
        F.count("*").cast("int").alias("n"))


BUCKETS = 8


def bucketed_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Orders as talks, their lines as features and as MFCCs, in equal buckets."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("talk"), "o_totalprice")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("talk"))
    features = lines.agg(F.sum("l_quantity").alias("spoken"), F.count("*").alias("lines"))
    mfcc = table(spark, folder, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("talk")).agg(
        F.max("l_discount").alias("loud"))
    excluded = features.where("lines < 2").select("talk", F.lit("lt2_utterances").alias("reason"))
    given = {"talks": orders, "features": features.where("lines >= 2"), "excluded": excluded, "mfcc": mfcc}
    out = []
    for name, rows in given.items():
        path = landing(spark, name)
        out.append(tables.write_bucketed(rows, path, f"rostrum_{name}", "talk", BUCKETS))
        until_exit(spark, path)
    return out


@query("""
with lines as (select l_orderkey as talk, sum(l_quantity) as spoken, count(*) as lines from lineitem group by 1),
mfcc as (select l_orderkey as talk, max(l_discount) as loud from lineitem where l_linenumber = 1 group by 1),
every as (
  select o_orderkey as talk, o_totalprice, spoken, loud,
         case when lines < 2 then 'lt2_utterances' when lines is null then 'no_result'
              when loud is null then 'no_mfcc' end as reason
  from orders left join lines on lines.talk = o_orderkey left join mfcc on mfcc.talk = o_orderkey
)
select coalesce(reason, 'joined') as reason, count(*) as n,
       round(sum(case when reason is null then o_totalprice + spoken + loud end), 2) as total
from every group by 1""")
def bucketed_talk_table(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table of written tables whose buckets agree, and the talks left out."""
    joined, out = feature_table(*bucketed_tables(spark, folder), "talk")
    counted = joined.agg(F.count("*").alias("n"), rounded(F.sum(F.col("o_totalprice") + F.col("spoken") + F.col("loud")), 2).alias("total"))
    return counted.select(F.lit("joined").alias("reason"), "n", "total").where("n > 0").unionByName(
        out.groupBy("reason").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("total")))
