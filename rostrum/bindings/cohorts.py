"""Top-k cohorts, folds and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.bindings.registry import query, rounded, table
from rostrum.operators import positions
from rostrum.operators.summaries import bottom_rows, cohorts, top_rows
from rostrum.plans.analysis import cohort_correlations as cohort_rank, cohort_histograms as ends

SQL_PRICED = ("(select o_orderkey, case when o_orderstatus <> 'P' then o_totalprice end as price "
              "from orders)")
SQL_TOP = f"(select * from {SQL_PRICED} order by price desc nulls last, o_orderkey limit 100)"
SQL_BOTTOM = f"(select * from {SQL_PRICED} order by price nulls first, o_orderkey desc limit 100)"


def priced_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price")
    )


@query(f"select * from {SQL_TOP}")
def top_100(spark: SparkSession, folder: str) -> DataFrame:
    return top_rows(priced_orders(spark, folder), "price", "o_orderkey")


@query(f"select * from {SQL_BOTTOM}")
def bottom_100(spark: SparkSession, folder: str) -> DataFrame:
    return bottom_rows(priced_orders(spark, folder), "price", "o_orderkey")


@query(f"select *, 'most' as rank from {SQL_TOP} union all "
       f"select *, 'least' as rank from {SQL_BOTTOM}")
def top_bottom_union(spark: SparkSession, folder: str) -> DataFrame:
    return cohorts(priced_orders(spark, folder), "price", "o_orderkey")


COHORT_METRICS = ("p_size", "p_partkey")


@query("""
with ranked as (
  (select * from part order by p_retailprice desc, p_partkey limit 100) union all
  (select * from part order by p_retailprice, p_partkey desc limit 100)
)
select 'p_size' as feature, count(*) as n, round(corr(p_size, p_retailprice), 6) as r from ranked
union all
select 'p_partkey', count(*), round(corr(p_partkey, p_retailprice), 6) from ranked""")
def cohort_correlations(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("key"), "p_retailprice", *COHORT_METRICS
    )
    return cohort_rank(parts, "p_retailprice", "key", COHORT_METRICS).withColumn(
        "r", rounded("r")
    )


@query("""
with ranked as (
  (select 'most' as rank, * from part order by p_retailprice desc, p_partkey limit 100) union all
  (select 'least' as rank, * from part order by p_retailprice, p_partkey desc limit 100)
), span as (select min(p_size) as lo, max(p_size) as hi from ranked), placed as (
  select rank, least(floor((p_size - lo) / (hi - lo)::double * 10), 9)::bigint as bin, lo, hi
  from ranked, span
)
select rank, bin, 'p_size' as feature, round(any_value(lo + (hi - lo) * bin / 10.0::double), 6) as bin_start,
       round(any_value(lo + (hi - lo) * (bin + 1) / 10.0::double), 6) as bin_end, count(*) as n
from placed group by rank, bin""")
def cohort_histograms(spark: SparkSession, folder: str) -> DataFrame:
    return ends(table(spark, folder, "part"), "p_retailprice", "p_partkey", ["p_size"], 10).withColumns({
        c: rounded(c) for c in ("bin_start", "bin_end")
    })


SQL_HASH = "('0x' || substr(md5(doc_id::varchar || '|42'), 1, 8))::bigint"


@query(f"select doc_id, {SQL_HASH} % 5 as fold from documents")
def folds(spark: SparkSession, folder: str) -> DataFrame:
    return positions.hash_folds(
        table(spark, folder, "documents").select("doc_id"), "doc_id"
    )


@query(f"select doc_id, (ntile(5) over (order by {SQL_HASH}, doc_id) - 1)::bigint as fold "
       "from documents")
def balanced_folds(spark: SparkSession, folder: str) -> DataFrame:
    return positions.balanced_folds(
        table(spark, folder, "documents").select("doc_id"), "doc_id"
    )


@query(f"select doc_id, {SQL_HASH} % 100 < 20 as is_test from documents")
def holdout(spark: SparkSession, folder: str) -> DataFrame:
    return positions.holdout(table(spark, folder, "documents").select("doc_id"), "doc_id")
