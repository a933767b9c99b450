"""Nested per-utterance model outputs, one JSON document per talk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rostrum.functions.numeric import col
from rostrum.functions.vectors import parse_vector
from rostrum.vocab import EMBEDDING_TASK

# Times and posteriors may be numbers or text in the documents: text takes both.
PREDICTION = (
    "struct<id:string,startTime:string,endTime:string,task:string,"
    "prediction:array<struct<label:string,posterior:string>>,embedding:string>"
)


def first_value(document: Column | str) -> Column:
    """JSON text under the document's first key, whatever other keys hold."""
    return F.get(F.map_values(F.from_json(col(document), "map<string,string>")), F.lit(0))


def first_predictions(document: Column | str) -> Column:
    """The prediction list under the document's first key.

    Where every key holds a list, or there is only one key, the document is parsed once. A
    key that holds something else makes that parse NULL, and the first key's text is taken
    out and parsed by itself.
    """
    lists = F.from_json(col(document), f"map<string,array<{PREDICTION}>>")
    return F.coalesce(
        F.get(F.map_values(lists), F.lit(0)), F.from_json(first_value(document), f"array<{PREDICTION}>")
    )


def _typed(predictions: str) -> Column:
    return F.transform(predictions, lambda x: F.struct(
        x["label"].alias("label"), x["posterior"].try_cast("double").alias("posterior"),
    ))


def _no_vector(vector: str) -> Column:
    return F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull())


def explode_predictions(df: DataFrame, key: str, document: str) -> DataFrame:
    """One row per prediction, with its place in the list.

    `bad` marks text that should be a number or vector and is not: the caller
    leaves such talks out rather than stopping the whole query. A document that holds
    no list of predictions gives one row without place or id, so that its talk is
    told apart from one without a document; an empty list gives none.
    """
    is_vector = F.col("p.task") == EMBEDDING_TASK
    lists = df.select(key, first_predictions(document).alias("list"))
    # Without a list, or with something in it that is no prediction, there is no talk to sum up.
    rows = lists.select(key, F.posexplode(
        F.coalesce("list", F.array(F.lit(None).cast(PREDICTION)))
    ).alias("pos", "p"))
    # Parsed in a projection of its own: the vector is used three times below.
    rows = rows.select(
        key, F.when(F.col("p").isNotNull(), F.col("pos").cast("long")).alias("pos"), "p",
        F.when(is_vector, parse_vector("p.embedding")).alias("vector"),
    )
    return rows.select(
        key,
        "pos",
        F.col("p.id").alias("id"),
        F.col("p.startTime").try_cast("double").alias("st"),
        F.col("p.endTime").try_cast("double").alias("et"),
        F.col("p.task").alias("task"),
        _typed("p.prediction").alias("prediction"),
        "vector",
        F.coalesce(
            is_vector & _no_vector("vector"), F.lit(False)
        ).alias("bad"),
    )


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of every `<filename>.json` in a folder.

    A document is one row, in one task, until its list is exploded; the rows then spread
    by (talk, utterance). For talks of more than some hundred megabytes use
    `read_predictions`, whose files hold a line per prediction.
    """
    documents = (
        spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
        .select(
            # The metadata column holds the name as part of a URL.
            F.regexp_replace(
                F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))),
                r"\.json$", "",
            ).alias("filename"),
            F.col("value").alias("document"),
        )
    )
    return explode_predictions(documents, "filename", "document")


def read_predictions(spark: SparkSession, path: str, key: str = "filename") -> DataFrame:
    """Predictions from JSON lines, one per line: the fields of a document's list entries,
    with the talk's `key` and the place `pos` in its list. Files split anywhere, so a talk
    of any length is read by many tasks."""
    lines = spark.read.schema(
        f"`{key}` string, pos bigint, id string, startTime string, endTime string, task string, "
        "prediction array<struct<label:string,posterior:string>>, embedding string"
    ).json(path)
    is_vector = F.col("task") == EMBEDDING_TASK
    rows = lines.withColumn("vector", F.when(is_vector, parse_vector("embedding")))
    return rows.select(
        key, "pos", "id", F.col("startTime").try_cast("double").alias("st"),
        F.col("endTime").try_cast("double").alias("et"), "task",
        _typed("prediction").alias("prediction"), "vector",
        F.coalesce(is_vector & _no_vector("vector"), F.lit(False)).alias("bad"),
    )
