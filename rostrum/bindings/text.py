"""Text, keys and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.bindings.registry import query, table
from rostrum.functions import text as X
from rostrum.operators.positions import add_appearance_code, appearance_codes
from rostrum.operators.summaries import join_on_text, unmatched
from rostrum.plans.analysis import transcript_inputs as inputs
from rostrum.sources.tables import csv_value
from rostrum.vocab import MAX_TOKENS

# What Java's Unicode blank class and the four separators hold, for RE2.
SQL_BLANKS = (
    r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]+"
)
SQL_WORDS = f"list_filter(string_split_regex(text, '{SQL_BLANKS}'), lambda x: x <> '')"


@query(r"""
with cleaned as (
  select doc_id, regexp_replace(text, '\(.*?\)', '', 'g') as clean from documents
)
select doc_id, length(clean)::int as chars, md5(clean) as digest from cleaned where clean <> ''""")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = table(spark, folder, "documents").select(
        "doc_id", X.clean_transcript("text").alias("clean")
    )
    return cleaned.where(F.col("clean") != "").select(
        "doc_id", F.length("clean").alias("chars"), F.md5("clean").alias("digest")
    )


@query(rf"""
with cleaned as (
  select doc_id, regexp_replace(text, '\(.*?\)', '', 'g') as text from documents
)
select doc_id, md5(array_to_string({SQL_WORDS}[1:{MAX_TOKENS}], ' ')) as digest from cleaned where text <> ''""")
def transcript_inputs(spark: SparkSession, folder: str) -> DataFrame:
    texts = inputs(table(spark, folder, "documents"), "doc_id", "text")
    return texts.select("doc_id", F.md5("text").alias("digest"))


@query("""
with fields as (
  select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then l_quantity::varchar
           when 1 then l_discount::varchar when 2 then 'NA' else l_orderkey::varchar end as field
  from lineitem
), read as (
  select l_orderkey, l_linenumber, case when field <> 'NA' and field::double = floor(field::double)
         then field::double::bigint end as whole, try_cast(nullif(field, 'NA') as double) as real
  from fields
)
select l_orderkey, l_linenumber, count(whole) as wholes, coalesce(sum(whole), 0)::bigint as whole,
       round(coalesce(sum(real), 0), 6) as real
from read group by 1, 2""")
def csv_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of CSV text as whole and as real numbers: `17.0`, `0.05`, a missing word, a key."""
    kind = F.col("l_linenumber") % 4
    field = (
        F.when(kind == 0, F.col("l_quantity").cast("string"))
        .when(kind == 1, F.col("l_discount").cast("string"))
        .when(kind == 2, "NA").otherwise(F.col("l_orderkey").cast("string"))
    )
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", field.alias("field"))
    return rows.select(
        "l_orderkey", "l_linenumber", csv_value(F.col("field"), "bigint").alias("w"),
        csv_value(F.col("field"), "double").alias("r"),
    ).groupBy("l_orderkey", "l_linenumber").agg(
        F.count("w").alias("wholes"), F.coalesce(F.sum("w"), F.lit(0)).alias("whole"),
        F.round(F.coalesce(F.sum("r"), F.lit(0.0)), 6).alias("real"),
    )


@query(f"select doc_id, len({SQL_WORDS})::int as words from documents")
def word_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.word_count("text").alias("words"))


@query(f"""
select doc_id, md5(array_to_string({SQL_WORDS}[1:200], ' ')) as digest from documents""")
def truncate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(X.truncate_tokens("text", 200)).alias("digest")
    )


@query("select conv_id, turn, md5(trim(text, chr(9)||chr(10)||chr(13)||' ')) as digest "
       "from conversations")
def strip_text(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit(" \t\n"), "text", F.lit("\r \n"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.md5(X.strip(padded)).alias("digest")
    )


@query("select url, a.page_id as left_id, b.page_id as right_id from pages a join pages b "
       "using (url)")
def url_join(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    left = pages.select(F.concat(F.lit("\t "), "url").alias("url"), F.col("page_id").alias("left_id"))
    right = pages.select(F.concat("url", F.lit(" \n")).alias("url"), F.col("page_id").alias("right_id"))
    return join_on_text(left, right, "url")


@query("select page_id, url from pages where url not like '%?%'")
def url_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    other = F.when(F.col("url").contains("?"), "").otherwise("#other")
    partners = pages.select(F.concat(F.lit(" "), "url", other, F.lit("\n")).alias("url"))
    return unmatched(pages, partners, "url")


@query("""
select source, (row_number() over (order by first_key) - 1)::bigint as code
from (select source, min(doc_id) as first_key from documents group by 1)""")
def speaker_code(spark: SparkSession, folder: str) -> DataFrame:
    return appearance_codes(table(spark, folder, "documents"), "source", "doc_id").select(
        "source", "code"
    )


@query("""
with codes as (
  select source, (row_number() over (order by min(doc_id)) - 1)::bigint as code
  from documents group by 1
)
select doc_id, code from documents join codes using (source)""")
def speaker_code_rows(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return add_appearance_code(documents, "source", "doc_id", "code").select("doc_id", "code")
