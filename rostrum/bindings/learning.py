"""Scaling and models. Fits have no SQL; their tests hold invariants instead."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.bindings.registry import query, rounded, sql_level, sql_z, table
from rostrum.functions.numeric import band
from rostrum.operators.components import project, wide_components
from rostrum.operators.models import principal_components, standardise
from rostrum.operators.positions import hash_folds
from rostrum.operators.summaries import cohorts
from rostrum.operators.zscore import zscore
from rostrum.plans.experiment import experiment, holdout_predictions, holdout_run


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings with two targets that can be learnt: levels of a sum and of a
    length of their first positions."""
    rows = table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x_embedding")
    )
    head = F.slice("x_embedding", 1, 4)
    rows = rows.withColumns({
        "x_posterior": F.transform("x_embedding", lambda x: x * x),
        "x_gender": F.array((F.get("x_embedding", F.lit(0)) > 0).cast("double")),
        "x_mfcc": F.transform("x_embedding", F.abs),
        "x_text": F.reverse("x_embedding"),
        "sum": F.aggregate(head, F.lit(0.0), lambda a, x: a + x),
        "length": F.aggregate(head, F.lit(0.0), lambda a, x: a + x * x),
    })
    scored = zscore(rows, ["sum", "length"])
    return scored.withColumns({
        "sum_cat": band("sum_norm"), "length_cat": band("length_norm"),
    })


SQL_FOLD = "('0x' || substr(md5(vec_id::varchar || '|42'), 1, 8))::bigint % 5"


@query(f"""
with long as (
  select vec_id, {SQL_FOLD} as fold, unnest(range(len(embedding)))::int as pos,
         unnest(embedding)::double as x
  from embeddings
), stats as (
  select pos, avg(x) as m, stddev_pop(x) as s from long where fold <> 0 group by 1
)
select vec_id, pos, round((x - m) / s, 6) as value from long join stats using (pos)""")
def scaled(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors, scaled by the training part of the first fold."""
    rows = hash_folds(vectors(spark, folder), "vec_id").select(
        "vec_id", "fold", F.col("x_embedding").alias("x")
    )
    (_, whole), _ = standardise(rows.where(F.col("fold") != 0), [rows])
    return whole.select("vec_id", F.posexplode(vector_to_array("x")).alias("pos", "value")).select(
        "vec_id", "pos", rounded("value").alias("value")
    )


@query()
def pca2(spark: SparkSession, folder: str) -> DataFrame:
    """Two components of the vectors at both ends of a target."""
    ends = cohorts(vectors(spark, folder), "sum_norm", "vec_id")
    return principal_components(
        ends.select("vec_id", "rank", "x_embedding"), "x_embedding"
    ).withColumns({c: rounded(c) for c in ("pc1", "pc2")})


@query()
def pca_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The components of `pca2`, without the matrix of all pairs of positions."""
    ends = cohorts(vectors(spark, folder), "sum_norm", "vec_id")
    return wide_components(
        ends.select("vec_id", "rank", "x_embedding"), "x_embedding"
    ).withColumns({c: rounded(c) for c in ("pc1", "pc2")})


@query("""
select vec_id,
       round(list_sum([embedding[i]::double / i for i in range(1, len(embedding) + 1)]), 6) as falling,
       round(list_sum([embedding[i]::double * (case when i % 2 = 1 then 1 else -1 end)
                       for i in range(1, len(embedding) + 1)]), 6) as alternating
from embeddings""")
def projection(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors along two fixed directions."""
    rows = vectors(spark, folder).select("vec_id", "x_embedding")
    at = np.arange(rows.agg(F.max(F.size("x_embedding"))).first()[0] or 0)
    directions = np.stack([1.0 / (at + 1), np.where(at % 2 == 0, 1.0, -1.0)], axis=1)
    return project(rows, "x_embedding", directions, ["falling", "alternating"]).select(
        "vec_id", rounded("falling").alias("falling"), rounded("alternating").alias("alternating"))


@query("""
select rank, least(count(*), 100) as n, true as centred, true as uncorrelated
from embeddings, (select unnest(['most', 'least']) as rank) group by rank""")
def pca_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per end of the projection; its components have mean 0 and do not correlate."""
    ends = cohorts(vectors(spark, folder), "sum_norm", "vec_id")
    out = principal_components(ends.select("rank", "x_embedding"), "x_embedding")
    whole = out.agg(F.struct(
        (F.abs(F.avg("pc1")) + F.abs(F.avg("pc2")) < 1e-6).alias("centred"),
        (F.abs(F.covar_pop("pc1", "pc2")) < 1e-6).alias("uncorrelated"),
    ).alias("c")).scalar()
    return out.groupBy("rank").agg(F.count("*").alias("n")).withColumn("_c", whole).select(
        "rank", "n", "_c.centred", "_c.uncorrelated"
    )


@query(f"""
with lengths as (
  select vec_id, list_sum(list_transform(embedding[1:4], lambda x: x::double * x::double)) as length
  from embeddings
), scored as (
  select vec_id, {sql_z('length')} as z from lengths
)
select {sql_level('z')} as y, count(*) as n, count(distinct vec_id) as keys, true as adds_up
from scored where ('0x' || substr(md5(vec_id::varchar || '|42'), 1, 8))::bigint % 100 < 20
group by 1""")
def forest_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The hold-out's predicted rows by true class: each key once, probabilities adding to 1."""
    out = holdout_predictions(
        vectors(spark, folder), "vec_id", "length_cat", ("x_posterior",), "forest"
    )
    total = F.col("low") + F.col("medium") + F.col("high")
    return out.groupBy("y").agg(
        F.count("*").alias("n"), F.count_distinct("key").alias("keys"),
        F.bool_and(F.abs(total - 1) < 1e-9).alias("adds_up"),
    )


@query()
def rbf_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """One kernel machine on an 80/20 split: accuracy and weighted F1."""
    scores, _ = holdout_run(
        vectors(spark, folder), "vec_id", "sum_cat", ("x_embedding",), "kernel",
    )
    return scores


@query()
def ridge_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """The split of `rbf_holdout` for the kernel machine of many landmarks."""
    scores, _ = holdout_run(
        vectors(spark, folder), "vec_id", "sum_cat", ("x_embedding",), "kernel", machine="ridge",
    )
    return scores


@query()
def forest_holdout(spark: SparkSession, folder: str) -> DataFrame:
    scores, _ = holdout_run(
        vectors(spark, folder), "vec_id", "length_cat", ("x_posterior",), "forest",
    )
    return scores


@query()
def cv_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The grid of all feature sets, with one target. A failed run is an error: without it the
    scores would be those of a smaller grid."""
    scores, _, _ = experiment(vectors(spark, folder), "vec_id", {"length": "length_cat"}, whole=True)
    return scores
