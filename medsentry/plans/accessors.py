"""Reads of the stored corpus: counts, lookups, top terms, coverage and data-quality figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_counts(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, rows): one count a dataset, each from Parquet metadata where the source allows it."""
    out = None
    for name, df in datasets.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def drugs_of(drugs: DataFrame, primaryid: int) -> DataFrame:
    return drugs.filter(F.col("primaryid") == primaryid).orderBy("drug_seq")


def reactions_of(reactions: DataFrame, primaryid: int) -> DataFrame:
    return reactions.filter(F.col("primaryid") == primaryid).orderBy("pt")


def top_reactions(reactions: DataFrame, limit: int = 50) -> DataFrame:
    """The terms with the most cases; equal numbers go by term. Pairs are made distinct before they are counted."""
    cases = reactions.filter("pt is not null").select("pt", "primaryid").distinct()
    return cases.groupBy("pt").agg(F.count("*").alias("cases")).orderBy(F.desc("cases"), "pt").limit(limit)


def prod_ai_coverage(drugs: DataFrame) -> DataFrame:
    n, own = F.count("*"), F.count("prod_ai")
    return drugs.groupBy("quarter").agg(n.alias("rows"), own.alias("with_prod_ai"), F.round(100.0 * own / n, 2).alias("pct"))


def date_precisions(cases: DataFrame, column: str = "event_dt_precision") -> DataFrame:
    return cases.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def case_field_nulls(cases: DataFrame) -> DataFrame:
    """One row of missing values, in one pass."""
    missing = {"age_missing": "age_years", "weight_missing": "weight_kg", "sex_missing": "sex", "country_missing": "country", "event_dt_missing": "event_dt"}
    return cases.agg(*(F.count_if(F.col(c).isNull()).alias(n) for n, c in missing.items()), F.count_if(F.col("country_source") == "reporter").alias("country_from_reporter_fallback"), F.count("*").alias("cases"))


def case_drug_reaction(drugs: DataFrame, reactions: DataFrame) -> DataFrame:
    """Distinct (primaryid, drugname_raw, pt). Each side is made distinct first, so the join makes no repeats."""
    d = drugs.filter("drugname_raw is not null").select("primaryid", "drugname_raw").distinct()
    r = reactions.filter("pt is not null").select("primaryid", "pt").distinct()
    return d.join(r, "primaryid")
