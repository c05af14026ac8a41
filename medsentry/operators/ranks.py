"""Exact order statistics without gathering the values in one task.

Equal values are counted first, so a value that a third of all rows have is one row. Distinct values are
range-partitioned; the ranges' sizes, as many as partitions, tell which range holds a wanted rank, and
only those ranges are numbered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def order_statistics(rows: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row with the quantile of ``column`` at each share, between its neighbours in proportion; nulls don't count, and of no values it is null.

    NaN sorts last, as everywhere in Spark.
    """
    counted = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranged = written(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("n")).collect())  # a row a partition
    total = sum(n for _, n in sizes)
    wanted: dict[str, tuple[int, int, float]] = {}
    for name, share in shares.items():
        at = share * max(0, total - 1)
        wanted[name] = (math.floor(at), math.ceil(at), at - math.floor(at))
    ranks = {r for low, high, _ in wanted.values() for r in (low, high)}
    before, first = {}, 0
    for part, n in sizes:
        if any(first <= r < first + n for r in ranks):
            before[part] = first
        first += n
    if not before:
        return rows.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(name) for name in shares))
    # Where the numbered ranges begin: literals, two a wanted rank at most.
    begin = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("part"))
    low = begin + F.sum("n").over(Window.partitionBy("part").orderBy("v")) - F.col("n")
    placed = ranged.filter(F.col("part").isin(*before)).select("v", low.alias("low"), "n")

    def value(rank: int):
        return F.max(F.when((F.col("low") <= rank) & (F.col("low") + F.col("n") > rank), F.col("v")))

    found = placed.agg(*(value(r).alias(f"r{r}") for r in sorted(ranks)))
    between = lambda a, b, f: F.col(f"r{a}") if a == b else F.col(f"r{a}") * (1 - f) + F.col(f"r{b}") * f
    return found.select(*(between(*w).alias(name) for name, w in wanted.items()))
