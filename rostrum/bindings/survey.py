"""Documents as talks of the correlation survey."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rostrum.bindings.registry import query, rounded, table
from rostrum.bindings.text import SQL_WORDS
from rostrum.plans.analysis import survey_columns, survey_matrix, survey_table

NAMES = ("chars", "quality")
COLUMNS = ("comments", "speaker_id", "wc", "wpm", "duration", "comments_views", "views_comments", "age")


def survey(spark: SparkSession, folder: str) -> DataFrame:
    """The source speaks, the language tells the age; a rating is listed twice, so
    that its last entry counts. Documents without labels have no comments, and every
    seventh has no transcript."""
    labels = table(spark, folder, "labels")
    documents = table(spark, folder, "documents").join(labels, "doc_id", "left")
    lang, chars = F.col("lang"), F.col("n_chars")

    def rating(name: str, count: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), count.cast("bigint").alias("count"))

    talks = documents.select(
        "doc_id", F.col("source").alias("main_speaker"),
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("transcript"),
        chars.alias("duration"), (chars % 1000).alias("views"),
        (F.col("quality") * 3 + F.col("toxic")).alias("comments"),
        F.when(lang == "en", "18 - 22").when(lang == "fr", "23 - 30").when(lang == "de", "46 - 65")
        .alias("age"),
        F.array(
            rating("chars", F.lit(9)), rating("quality", F.coalesce("quality", F.lit(0)) + 1),
            rating("chars", chars),
        ).alias("ratings"),
    )
    return survey_columns(talks, "doc_id", NAMES)


SQL_SURVEY = f"""
with codes as (
  select source, (row_number() over (order by min(doc_id)) - 1)::bigint as speaker_id
  from documents group by 1
), talks as (
  select d.doc_id, speaker_id, n_chars, n_chars % 1000 as views, quality * 3 + toxic as comments,
         case when d.doc_id % 7 <> 0 then len({SQL_WORDS}) else 0 end::int as wc,
         case lang when 'en' then 0 when 'fr' then 1 when 'de' then 3 end::int as age,
         10 + n_chars + coalesce(quality, 0) as total, coalesce(quality, 0) + 1 as q
  from documents d join codes using (source) left join labels l on l.doc_id = d.doc_id
), survey as (
  select doc_id, comments, speaker_id, wc, wc / (n_chars / 60) as wpm, n_chars / 60 as duration,
         comments / nullif(views, 0) as comments_views,
         views / nullif(comments, 0) as views_comments, age,
         n_chars / total as chars, q / total as quality
  from talks
)"""
REALS = ("wpm", "duration", "comments_views", "views_comments", *NAMES)


@query(f"""{SQL_SURVEY}
select doc_id, speaker_id, wc, age, {', '.join(f'round({c}, 6) as {c}' for c in REALS)}
from survey""")
def survey_rows(spark: SparkSession, folder: str) -> DataFrame:
    return survey(spark, folder).select(
        "doc_id", "speaker_id", "wc", "age", *[rounded(c).alias(c) for c in REALS]
    )


def _table_sql() -> str:
    cell = "case when abs(corr({a}, {b})) < 0.2 then '-' else round(corr({a}, {b}), 3)::varchar end"
    rows = " union all ".join(
        f"select '{a}' as a, " + ", ".join(f"{cell.format(a=a, b=b)} as {b}" for b in NAMES)
        + " from survey"
        for a in COLUMNS
    )
    return f"{SQL_SURVEY} {rows}"


@query(_table_sql())
def survey_correlations(spark: SparkSession, folder: str) -> DataFrame:
    return survey_table(survey(spark, folder), COLUMNS, NAMES)


@query(f"""{SQL_SURVEY}
select a, b, n, round(r, 6) as r from ({' union all '.join(
    f"select '{a}' as a, '{b}' as b, regr_count({a}, {b})::bigint as n, corr({a}, {b}) as r "
    "from survey" for a, b in combinations([*NAMES, *COLUMNS], 2))})""")
def survey_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return survey_matrix(survey(spark, folder), COLUMNS, NAMES).withColumn("r", rounded("r"))
