"""Reading the input tables and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rostrum.functions.ratings import parse_ratings
from rostrum.functions.vectors import parse_vector
from rostrum.sources.csv_records import fields_by_name

TALK_SCHEMA = (
    "url string, filename string, main_speaker string, speaker_occupation string, "
    "num_speaker bigint, film_date bigint, published_date bigint, views bigint, "
    "comments bigint, duration bigint, languages bigint, transcript string, ratings string"
)
MFCC_SCHEMA = "filename string, mfccs_mean array<double>, mfccs_std array<double>"
EMBEDDING_SCHEMA = "url string, embeddings string"
SCORE_SCHEMA = "target string, type string, metric string, value double"

# Words a CSV field uses for "missing".
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def _read_csv(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """CSV by column name, with quoted line breaks and doubled quotes.

    Files of any size are read by many tasks, and each by its own header, so a column keeps
    its name wherever it stands. Every column comes in as text first, so that the words for
    "missing" can be told from data before the cast to the schema's type. A field that is no
    number of its column's type becomes NULL; `strict` stops at it.
    """
    wanted = spark.createDataFrame([], schema).schema
    return fields_by_name(spark, path, wanted.names).select(*[
        csv_value(F.col(f"`{f.name}`"), f.dataType.simpleString(), strict).alias(f.name) for f in wanted
    ])


def csv_value(text: Column, kind: str, strict: bool = False) -> Column:
    """A CSV field as a value: words for "missing" are NULL, and a whole number may be
    written with a fraction of zeros (`3.0`)."""
    given = F.when(~text.isin(*MISSING_WORDS), text)
    if kind == "string":
        return given
    if kind != "bigint":
        return given.cast(kind) if strict else given.try_cast(kind)
    # The number itself first: a large id must not pass through a float.
    loose = given.try_cast("decimal(38,10)")
    value = F.coalesce(given.try_cast("bigint"), F.when(loose == F.floor(loose), loose.try_cast("bigint")))
    if strict:
        broken = given.isNotNull() & value.isNull()
        return F.when(broken, F.raise_error(F.concat(F.lit("no whole number: "), given))).otherwise(value)
    return value


def _format(path: str, format: str | None) -> str:
    return format or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")


def read_talks(
    spark: SparkSession, path: str, schema: str = TALK_SCHEMA, strict: bool = False
) -> DataFrame:
    """Talk metadata with `ratings` decoded. Columns not in `schema` are left out."""
    talks = _read_csv(spark, path, schema, strict)
    return talks.withColumn("ratings", parse_ratings("ratings"))


def read_mfcc(spark: SparkSession, path: str) -> DataFrame:
    """MFCC mean and std vectors per talk, from Parquet."""
    return spark.read.schema(MFCC_SCHEMA).parquet(path)


def read_text_embeddings(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Transcript embeddings: CSV with list text, or Parquet with arrays. Without `format`
    the path's ending tells them apart; name it for a folder of CSV parts."""
    if _format(path, format) == "csv":
        table = _read_csv(spark, path, EMBEDDING_SCHEMA)
        return table.withColumn("embeddings", parse_vector("embeddings"))
    return spark.read.parquet(path).select(
        "url", F.col("embeddings").cast("array<double>").alias("embeddings")
    )


def read_scores(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """The long score table."""
    if _format(path, format) == "csv":
        return _read_csv(spark, path, SCORE_SCHEMA)
    return spark.read.schema(SCORE_SCHEMA).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet: arrays stay typed and nothing passes through text."""
    df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, path: str, name: str, key: str, buckets: int) -> DataFrame:
    """Parquet dealt into files by a hash of `key` and sorted by it, as table `name` of the
    session. Tables with the same buckets join and group on the key without a shuffle."""
    spark = df.sparkSession
    spark.sql(f"drop table if exists `{name}`")
    # Rows of a bucket meet before they are written, so a bucket is one file.
    df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(
        key
    ).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, name: str, key: str, buckets: int) -> DataFrame:
    """What `write_bucketed` wrote, in another session: `name` with the same buckets."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"drop table if exists `{name}`")
    spark.sql(
        f"create table `{name}` ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) "
        f"into {buckets} buckets location '{path}'"
    )
    return spark.table(name)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV for other programs; nested columns become JSON text."""
    nested = ("array", "map", "struct")
    df.select(*[
        (F.to_json(f"`{name}`").alias(name) if kind.startswith(nested) else F.col(f"`{name}`"))
        for name, kind in df.dtypes
    ]).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
