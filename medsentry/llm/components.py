"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link every node's neighbours to the smallest of them: the larger ones, or the smaller ones and itself."""
    if larger:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    joined = near.join(least, near.u == least.w)
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (u, v: long) and the smallest node it can reach.

    A hub is one key among its neighbours' rows and sums up before each shuffle; the join with
    the minima is a plain equi-join whose large partitions adaptive execution splits. Every round
    is written to the shared folder, and the rounds end when one changes nothing. Nodes without
    an edge to another node don't appear.
    """
    now = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        now = stored(_stars(_stars(now, True), False), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = state
