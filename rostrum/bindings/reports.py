"""Reports over many columns at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.bindings.registry import query, rounded, table
from rostrum.bindings.targets import EVENT_TYPES, SQL_TOP, user_talks
from rostrum.operators.correlate import corr_matrix
from rostrum.operators.order_stats import described_sketches, merge_sketches, quantile_sketches
from rostrum.operators.summaries import most_common
from rostrum.plans import analysis

PRICES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _histogram_sql(column: str) -> str:
    return f"""select '{column}' as target, bin, round(any_value(lo + (hi - lo) * bin / 50), 6) as bin_start,
       round(any_value(lo + (hi - lo) * (bin + 1) / 50), 6) as bin_end, count(*) as n
from (select lo, hi, least(floor(({column} - lo) / (hi - lo) * 50), 49)::bigint as bin
      from lineitem, (select min({column})::double as lo, max({column})::double as hi from lineitem)) group by bin"""


@query(" union all ".join(map(_histogram_sql, PRICES)))
def target_histograms(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty bins of every number of the order lines."""
    return analysis.target_histograms(table(spark, folder, "lineitem"), PRICES).withColumns({
        c: rounded(c) for c in ("bin_start", "bin_end")
    })


LEVELS = ("l_returnflag", "l_linestatus")


@query(" union all ".join(
    f"select '{c}' as target, {c} as level, count(*) as n from lineitem group by 2" for c in LEVELS))
def level_counts(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.level_counts(table(spark, folder, "lineitem"), LEVELS)


@query(SQL_TOP + " " + " union all ".join(f"""
select '{t}' as rating, case when holds then 'positive' else 'negative' end as side, count(*) as n
from (select user_id, bool_or(name = '{t}') as holds from ranked where k <= 2 group by 1) group by 2"""
                                          for t in EVENT_TYPES))
def rating_tops(spark: SparkSession, folder: str) -> DataFrame:
    """For each event type, the users with it among their two most frequent and the others."""
    return analysis.rating_tops(user_talks(spark, folder), EVENT_TYPES, k=2)


@query("""
with ranked as (
  (select 'most' as rank, * from part order by p_retailprice desc, p_partkey limit 100) union all
  (select 'least' as rank, * from part order by p_retailprice, p_partkey desc limit 100)
), scaled as (
  select p_partkey, rank, (p_size - avg(p_size) over ()) / stddev_pop(p_size) over () as a,
         (p_partkey - avg(p_partkey) over ()) / stddev_pop(p_partkey) over () as b
  from ranked
), turned as (select *, case when corr(a, b) over () < 0 then -1 else 1 end as s from scaled)
select p_partkey, rank, round(abs(a + s * b) / sqrt(2), 6) as pc1, round(abs(a - s * b) / sqrt(2), 6) as pc2
from turned""")
def cohort_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Both ends of the parts on the components of two columns. Those are fixed, whatever the
    rows are, up to their signs: half-way between the columns, and across."""
    parts = table(spark, folder, "part").select(
        "p_partkey", "p_retailprice", F.array(F.col("p_size").cast("double")).alias("size"),
        F.array(F.col("p_partkey").cast("double")).alias("number"),
    )
    out = analysis.cohort_projection(parts, "p_retailprice", "p_partkey", ["size", "number"])
    return out.withColumns({c: rounded(F.abs(c)) for c in ("pc1", "pc2")})


@query("""
select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 100""")
def most_common_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 parts ordered most often, from a sketch's candidates."""
    return most_common(table(spark, folder, "lineitem"), "l_partkey", 100)


WIDTH, TILE = 64, 16


@query(f"""
select 'd' || i as a, 'd' || j as b, count(*) as n, round(corr(embedding[i + 1]::double, embedding[j + 1]::double), 6) as r
from embeddings, range({WIDTH}) as one(i), range({WIDTH}) as two(j) where i < j group by i, j""")
def corr_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of the vectors' 64 entries, in blocks of 16 columns."""
    names = [f"d{i}" for i in range(WIDTH)]
    wide = table(spark, folder, "embeddings").select(
        *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return corr_matrix(wide, names, TILE).withColumn("r", rounded("r"))


@query("""
with places as (
  select user_id, value, row_number() over (partition by user_id order by value) as place,
         count(*) over (partition by user_id) as n, avg(value) over (partition by user_id) as mean,
         stddev_pop(value) over (partition by user_id) as std
  from events
)
select user_id, any_value(n) as n, round(any_value(mean), 9) as mean, round(any_value(std), 9) as std,
       min(value) filter (where place >= 0.1 * n) as p10, min(value) filter (where place >= 0.9 * n) as p90
from places group by 1""")
def merged_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of users from sketches of their events by type, merged. A sketch keeps every
    value of so few, so the percentiles are those of the rows."""
    parts = quantile_sketches(table(spark, folder, "events"), ["user_id", "event_type"], "value").drop("event_type")
    out = described_sketches(merge_sketches(parts, ["user_id"]), ["user_id"])
    # Means of 64 cents end in a 5 at the seventh digit.
    return out.withColumns({c: rounded(c, 9) for c in ("mean", "std")})
