"""Tables of a relational database over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table, read in ``parts`` ranges of its numeric ``key``; without a key by one task.

    Filters and the choice of columns reach the database. The bounds of the key only cut the ranges: rows beyond
    them, or without a key, are read too.
    """
    read = spark.read.format("jdbc").options(url=url, **options)
    whole = read.option("dbtable", name)
    if not key:
        return whole.load()
    low, high = whole.load().agg(F.min(key), F.max(key)).first()
    if low is None:
        return whole.load()
    return whole.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts)).load()
