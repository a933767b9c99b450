"""Scalar maps, vectors, correlations, counts and histograms."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.bindings.registry import query, rounded, table
from rostrum.functions.numeric import flag_above, ordinal_map, ratio, relabel
from rostrum.functions.text import fill_text
from rostrum.functions.vectors import assemble, concat, parse_vector
from rostrum.operators.correlate import corr_matrix as matrix
from rostrum.operators.correlate import corr_rank as rank
from rostrum.operators.correlate import corr_table as rectangle
from rostrum.operators.summaries import drop_incomplete
from rostrum.operators.summaries import histogram as bins
from rostrum.operators.summaries import value_counts as counts
from rostrum.operators.vector_stats import weighted_vector_stats as vector_stats

PRIORITIES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}


@query("""
select o_orderkey,
       case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2
       end::int as code,
       (case when nullif(o_orderstatus, 'F') is not null and o_totalprice > 200000 then 1 else 0
        end)::int as flag,
       coalesce(nullif(o_orderstatus, 'P'), '') as status,
       case when o_orderstatus = 'O' then 'Open' else o_orderstatus end as renamed
from orders""")
def ordinal_flags(spark: SparkSession, folder: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    return table(spark, folder, "orders").select(
        "o_orderkey", ordinal_map("o_orderpriority", PRIORITIES).alias("code"),
        flag_above(price, 200000).alias("flag"),
        fill_text(F.nullif("o_orderstatus", F.lit("P"))).alias("status"),
        relabel("o_orderstatus", "O", "Open").alias("renamed"),
    )


@query("""
select l_orderkey, l_linenumber, l_partkey,
       round(l_extendedprice / nullif(l_tax, 0), 4) as price_per_tax,
       round(l_quantity / 60, 6) as minutes
from lineitem""")
def ratios(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        rounded(ratio("l_extendedprice", "l_tax"), 4).alias("price_per_tax"),
        rounded(ratio("l_quantity", F.lit(60))).alias("minutes"),
    )


@query("""
with whole as (
  select vec_id, list_concat(embedding::double[], list_reverse(embedding::double[])) as v
  from embeddings
)
select vec_id, unnest(range(len(v)))::int as pos, unnest(v) as value from whole""")
def vector_concat(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select(
        "vec_id", F.posexplode(concat(v, F.reverse(v))).alias("pos", "value")
    )


@query("""
select vec_id, len(embedding)::int as width, round(list_sum(embedding::double[]), 6) as total
from embeddings""")
def vector_text(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors written as list text and decoded again."""
    text = F.to_json(F.col("embedding").cast("array<double>"))
    return table(spark, folder, "embeddings").select(
        "vec_id", parse_vector(text).alias("v")
    ).select(
        "vec_id", F.size("v").alias("width"),
        rounded(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"),
    )


@query("""
select l_returnflag, l_linestatus, count(*) as n, count(nullif(l_tax, 0)) as whole,
       round(sum(case when l_tax <> 0 then l_quantity + l_discount + l_tax end), 4) as total
from lineitem group by 1, 2""")
def assembled(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").withColumn("tax", F.nullif("l_tax", F.lit(0.0)))
    rows = items.withColumn("x", assemble(["l_quantity", "l_discount", "tax"]))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count("x").alias("whole"),
        rounded(F.sum(F.get("x", F.lit(0)) + F.get("x", F.lit(1)) + F.get("x", F.lit(2))), 4)
        .alias("total"),
    )


def _vector_sql(weight: str) -> str:
    return f"""
with long as (
  select label, {weight} as w, unnest(range(len(embedding)))::int as pos,
         unnest(embedding)::double as x
  from embeddings
), means as (
  select label, pos, sum(w * x) / sum(w) as m, sum(w) as total from long group by 1, 2
)
select label, pos, round(any_value(m), 6) as mean,
       round(sqrt(sum(w * (x - m) * (x - m)) / any_value(total)), 6) as std
from long join means using (label, pos) group by 1, 2"""


def _vector_rows(stats: DataFrame) -> DataFrame:
    return stats.select("label", F.posexplode(F.arrays_zip("vec_mean", "vec_std")).alias("pos", "x")).select(
        "label", "pos", rounded("x.vec_mean").alias("mean"), rounded("x.vec_std").alias("std")
    )


@query(_vector_sql("1 + vec_id % 7"))
def weighted_vector_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").withColumn("w", 1 + F.col("vec_id") % 7)
    return _vector_rows(vector_stats(rows, ["label"], "embedding", "w"))


@query(_vector_sql("vec_id % 9 - 1"))
def signed_vector_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of -1 and 0 among the others, as overlapping times give them."""
    rows = table(spark, folder, "embeddings").withColumn("w", F.col("vec_id") % 9 - 1)
    return _vector_rows(vector_stats(rows, ["label"], "embedding", "w"))


ITEM_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "tax", "l_partkey", "l_suppkey")


def items_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Lineitem numbers; a zero tax counts as missing."""
    return table(spark, folder, "lineitem").withColumn("tax", F.nullif("l_tax", F.lit(0.0)))


SQL_ITEMS = "(select *, nullif(l_tax, 0) as tax from lineitem)"


def _pair_sql(pairs, name_a: str = "a", name_b: str = "b") -> str:
    return " union all ".join(
        f"select '{a}' as {name_a}, '{b}' as {name_b}, regr_count({a}, {b})::bigint as n, "
        f"corr({a}, {b}) as r from {SQL_ITEMS}"
        for a, b in pairs
    )


@query(f"select a, b, n, round(r, 6) as r from ({_pair_sql(combinations(ITEM_COLUMNS, 2))})")
def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return matrix(items_with_gaps(spark, folder), ITEM_COLUMNS).select(
        "a", "b", "n", rounded("r").alias("r")
    )


LEFT, RIGHT = ITEM_COLUMNS[1:4], ("l_quantity", "l_suppkey")


def _table_sql() -> str:
    cell = "case when abs(corr({a}, {b})) < 0.2 then '-' else round(corr({a}, {b}), 3)::varchar end"
    return " union all ".join(
        f"select '{a}' as a, " + ", ".join(f"{cell.format(a=a, b=b)} as {b}" for b in RIGHT)
        + f" from {SQL_ITEMS}"
        for a in LEFT
    )


@query(_table_sql())
def corr_table(spark: SparkSession, folder: str) -> DataFrame:
    return rectangle(items_with_gaps(spark, folder), LEFT, RIGHT, 0.2)


RANKED = [c for c in ITEM_COLUMNS if c != "l_extendedprice"]


@query(f"""
select a as feature, n, round(r, 6) as r
from ({_pair_sql([(c, 'l_extendedprice') for c in RANKED])}) order by abs(r) desc nulls last, a""")
def corr_rank(spark: SparkSession, folder: str) -> DataFrame:
    return rank(items_with_gaps(spark, folder), RANKED, "l_extendedprice").select(
        "feature", "n", rounded("r").alias("r")
    )


def _histogram_sql(by: str = "") -> str:
    return f"""
with span as (select min(value) as lo, max(value) as hi from events), placed as (
  select {by} lo, hi, least(floor((value - lo) / (hi - lo) * 20), 19)::bigint as bin
  from events, span
)
select {by} bin, round(any_value(lo + (hi - lo) * bin / 20), 6) as bin_start,
       round(any_value(lo + (hi - lo) * (bin + 1) / 20), 6) as bin_end, count(*) as n
from placed group by {by} bin"""


def _rounded_bins(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in ("bin_start", "bin_end")})


@query(_histogram_sql())
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_bins(bins(table(spark, folder, "events"), "value", 20))


@query(_histogram_sql("event_type,"))
def histogram_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_bins(bins(table(spark, folder, "events"), "value", 20, ["event_type"]))


@query("select event_type, count(*) as n from events group by 1 order by 2 desc, 1")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts(table(spark, folder, "events"), "event_type")


@query("select lang, source, count(*) as n from documents group by 1, 2 order by 3 desc, 1, 2")
def value_counts_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return counts(table(spark, folder, "documents"), "lang", "source")


@query("select count(*) as n from orders where year(o_orderdate) between 1996 and 2000")
def row_count(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.where(F.year("o_orderdate").between(1996, 2000)).agg(F.count("*").alias("n"))


@query("select distinct source from documents")
def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("source").distinct()


@query("""
select d.doc_id, lang, source, n_chars, quality, toxic
from documents d join labels l using (doc_id) where ln(nullif(toxic, 0)) is not null""")
def dropna_any(spark: SparkSession, folder: str) -> DataFrame:
    """Unlabelled documents lack a quality; the logarithm of no toxicity is missing too."""
    labels = table(spark, folder, "labels")
    joined = (
        table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
        .join(labels, "doc_id", "left").withColumn("log_toxic", F.ln("toxic"))
    )
    return drop_incomplete(joined).drop("log_toxic")


@query("""
select doc_id, nullif(lang, 'de') as lang, source from documents
where lang <> 'de'""")
def dropna_empty_text(spark: SparkSession, folder: str) -> DataFrame:
    """Empty text counts as missing, as it does after a trip through CSV."""
    documents = table(spark, folder, "documents").select(
        "doc_id", fill_text(F.nullif("lang", F.lit("de"))).alias("lang"), "source"
    )
    return drop_incomplete(documents, csv_parity=True)
