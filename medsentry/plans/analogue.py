"""Domain tables made from the driver's star schema, as DataFrames and as the same SQL.

Orders stand for cases (with republications of every tenth), their lines for drugs and reactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Corpus:
    """The analogue tables over one data folder. Nothing is read until a query uses it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def publications(self) -> DataFrame:
        """All publications; a republished case comes again a year later."""
        o = self.table("orders").join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        key = F.col("o_orderkey")
        own = o.select(
            key.alias("primaryid"),
            F.floor(key / 2).cast("bigint").alias("caseid"),
            (key % 2).alias("caseversion"),
            F.year("o_orderdate").alias("y"),
            F.quarter("o_orderdate").alias("q"),
            F.to_date("o_orderdate").alias("fda_dt"),
            F.when(key % 13 != 0, F.col("o_orderstatus")).alias("sex"),
            F.when(key % 17 != 0, F.col("c_nationkey").cast("string")).alias("country"),
            F.when(key % 3 == 0, "reporter").otherwise("occurrence").alias("country_source"),
            F.when(key % 11 != 0, F.col("o_totalprice") / 50000.0).alias("age_years"),
            F.when(key % 7 != 0, F.col("o_totalprice") / 1000.0).alias("weight_kg"),
            F.when(key % 5 != 0, F.to_date("o_orderdate")).alias("event_dt"),
            F.when(key % 5 == 0, "missing").when(key % 5 == 1, "month").otherwise("day").alias("event_dt_precision"),
        )
        every = own.unionByName(own.filter("primaryid % 10 = 0").withColumn("y", F.col("y") + 1))
        return every.withColumn("quarter", F.concat("y", F.lit("Q"), "q")).drop("y", "q")

    def drugs(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate")
        part = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        role = F.when(F.col("l_returnflag") == "A", "PS").when(F.col("l_returnflag") == "R", "SS").otherwise("C")
        return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("primaryid"),
            F.col("l_linenumber").cast("bigint").alias("drug_seq"),
            role.alias("role_cod"),
            F.col("p_name").alias("drugname_raw"),
            F.when(F.col("p_size") % 3 != 0, F.upper("p_brand")).alias("prod_ai"),
            F.col("p_type").alias("kind"),
            F.col("l_partkey").alias("part"),
            F.concat(F.year("l_shipdate"), F.lit("Q"), F.quarter("l_shipdate")).alias("quarter"),
        )

    def reactions(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey")
        s = self.table("supplier").select("s_suppkey", "s_nationkey")
        n = self.table("nation").select("n_nationkey", "n_regionkey")
        return lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("l_orderkey").alias("primaryid"), F.concat(F.lit("PT "), F.col("s_nationkey").cast("string")).alias("pt"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"))

    def duplicates(self) -> DataFrame:
        """Case records that another version replaced."""
        from ..operators.dedup import latest_publication, superseded_versions

        return superseded_versions(latest_publication(self.publications()))


#: The same tables as SQL for DuckDB.
SQL = """
own AS (
    SELECT o_orderkey AS primaryid, o_orderkey // 2 AS caseid, o_orderkey % 2 AS caseversion, year(o_orderdate) AS y, quarter(o_orderdate) AS q,
        CAST(o_orderdate AS DATE) AS fda_dt, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS sex, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS country,
        CASE WHEN o_orderkey % 3 = 0 THEN 'reporter' ELSE 'occurrence' END AS country_source, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 50000.0 END AS age_years,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1000.0 END AS weight_kg, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS event_dt,
        CASE o_orderkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'month' ELSE 'day' END AS event_dt_precision
    FROM orders JOIN customer ON o_custkey = c_custkey),
published AS (
    SELECT * EXCLUDE (y, q), concat(y, 'Q', q) AS quarter FROM (SELECT * FROM own UNION ALL SELECT * REPLACE (y + 1 AS y) FROM own WHERE primaryid % 10 = 0)),
cases AS (SELECT * FROM published QUALIFY row_number() OVER (PARTITION BY primaryid ORDER BY quarter DESC) = 1),
drugs AS (
    SELECT l_orderkey AS primaryid, CAST(l_linenumber AS BIGINT) AS drug_seq, CASE l_returnflag WHEN 'A' THEN 'PS' WHEN 'R' THEN 'SS' ELSE 'C' END AS role_cod, p_name AS drugname_raw,
        CASE WHEN p_size % 3 <> 0 THEN upper(p_brand) END AS prod_ai, p_type AS kind, l_partkey AS part, concat(year(l_shipdate), 'Q', quarter(l_shipdate)) AS quarter
    FROM lineitem JOIN part ON l_partkey = p_partkey),
reactions AS (
    SELECT l_orderkey AS primaryid, concat('PT ', s_nationkey) AS pt, concat('R', n_regionkey) AS region
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
superseded AS (
    SELECT primaryid, canonical_primaryid FROM (SELECT primaryid, first_value(primaryid) OVER (PARTITION BY caseid ORDER BY caseversion DESC, primaryid DESC) AS canonical_primaryid FROM cases)
    WHERE primaryid <> canonical_primaryid)"""
