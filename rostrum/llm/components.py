"""Connected components of a link table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rostrum.session import discard, durable


def components(links: DataFrame) -> DataFrame:
    """`(id, component)` of every linked id but the roots; a component is named by its
    least id. `links`: two id columns, in any direction, repeated or not.

    Alternating stars: every node points its larger neighbours to its least one, then
    its smaller ones. Each pass is two joins on the node; links shrink towards one per
    node, and the number of passes grows with the logarithm of the nodes. Each pass is
    written to the shared folder, and only one count reaches the driver. Links that are
    stars already, as those of most copies are, need no pass.
    """
    a, b = links.columns
    edges = durable(links.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).where("u <> v").distinct(), "edges")
    while _unfinished(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")
        ).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.*").where("u <> v").distinct()
        after = durable(small, "edges")
        discard(edges)
        edges = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or one that has a smaller one itself."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(
        edges.select("v", F.lit(0), F.lit(1))
    ).groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return not ends.where("out > 1 or (out > 0 and into > 0)").isEmpty()
