"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burdenframe.plans.workspace import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node that links reach) of every node with a link.

    Large-star and small-star steps in turn: each node's neighbours are linked to the smallest of them, first the larger
    ones, then the smaller, until all links are stars. Only minima and joins are used, so a node with very many links is
    no task's burden; the number of steps grows with the logarithm of the nodes. Every step is written out.
    """
    one = F.col(a) > F.col(b)
    edges = links.filter(F.col(a) != F.col(b)).select(F.when(one, F.col(a)).otherwise(F.col(b)).alias("u"),
                                                     F.when(one, F.col(b)).otherwise(F.col(a)).alias("v")).distinct()
    edges, before = stored(edges, "links"), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # links from a smallest node to its larger neighbours stay as they are
        edges = large.distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.filter("u != v").distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
