"""From raw documents to packed sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, folder) and returns a DataFrame; all but the last return the
columns of `docs`. `run` writes each result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.llm import decontaminate
from rostrum.llm.bound import LEAST_TAIL, document_pieces, graded
from rostrum.llm.linededup import dedup_lines
from rostrum.llm.neardup import drop_near_duplicates
from rostrum.llm.packing import pack
from rostrum.llm.registry import table
from rostrum.session import durable


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose grade is probably in the upper half; without ratings, all."""
    scored, (_, _, tail) = graded(docs, table(spark, folder, "labels"))
    return scored.where(F.col(tail) >= LEAST_TAIL).select(*docs.columns)


def new_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the lines that a smaller document holds; `n_chars` follows."""
    out = dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in out.columns else out


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = table(spark, folder, "benchmark").select("item_id", "text")
    marked, (flag, *_) = decontaminate.mark(docs, items)
    return marked.where(~F.col(flag)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    return pack(document_pieces(docs)).select(
        F.col("doc").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    )


STAGES = [
    ("quality", good_quality),
    ("line_dedup", new_lines),
    ("near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

# The quality and MinHash stages have no SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
