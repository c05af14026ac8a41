"""Matching of reported drug strings to ingredients with local vocabulary tables.

Three rungs, the first that holds wins: a curated override of the whole string, then for each
component an exact concept, then the best-ranked approximate candidate that has ingredients.

Vocabulary tables: ``exact`` (term, rxcui, name, tty), ``approximate`` (term, rxcui, name, tty, rank, score),
``ingredients`` (rxcui, ingredient_rxcui, ingredient_name, ingredient_tty); terms are folded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NormalizationError
from ..functions.drugnames import clean
from ..sources.store import recovered, write_whole
from ..storage import written

OVERRIDE, NOT_A_DRUG, EXACT, APPROXIMATE, UNMATCHED = "override", "override_not_a_drug", "exact", "approximate", "unmatched"


def cleaned_strings(rows: DataFrame, fields: tuple[str, ...] = ("drugname_raw", "prod_ai")) -> DataFrame:
    """(source_field, folded, cleaned, components, steps, occurrences) of every distinct string; each is cleaned once."""
    out = None
    for field in fields:
        part = rows.filter(F.trim(field) != "").groupBy(F.col(field).alias("raw")).agg(F.count("*").alias("occurrences")).select(F.lit(field).alias("source_field"), "raw", "occurrences")
        out = part if out is None else out.unionByName(part)
    c = out.withColumn("c", clean(F.col("raw")))
    return c.groupBy("source_field", F.col("c.folded").alias("folded")).agg(F.first("c.cleaned").alias("cleaned"), F.first("c.components").alias("components"), F.first("c.steps").alias("steps"), F.sum("occurrences").alias("occurrences"))


def _resolved(components: DataFrame, exact: DataFrame, approximate: DataFrame, ingredients: DataFrame) -> DataFrame:
    """(component, rxcui, rank, score, approximate, ingredients) of the components that have any."""
    own = ingredients.groupBy("rxcui").agg(F.array_sort(F.collect_set(F.struct("ingredient_rxcui", "ingredient_name", "ingredient_tty"))).alias("ingredients"))
    hit = exact.join(own, "rxcui").groupBy("term").agg(F.min(F.struct("rxcui", "ingredients")).alias("x"))
    near = approximate.join(own, "rxcui").groupBy("term").agg(F.min(F.struct("rank", "rxcui", "score", "ingredients")).alias("y"))
    both = components.join(hit, components.component == hit.term, "left").drop("term").join(near, F.col("component") == near.term, "left").drop("term")
    found = both.filter("x is not null or y is not null")
    use = F.col("x").isNotNull()
    return found.select("component", F.when(use, F.col("x.rxcui")).otherwise(F.col("y.rxcui")).alias("rxcui"), F.when(~use, F.col("y.rank")).alias("rank"), F.when(~use, F.col("y.score")).alias("score"), (~use).alias("approximate"), F.when(use, F.col("x.ingredients")).otherwise(F.col("y.ingredients")).alias("ingredients"))


def match(strings: DataFrame, exact: DataFrame, approximate: DataFrame, ingredients: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row a string: method, rxcui (null for combinations), ingredients in order without repeats, component counts.

    ``overrides``: (folded, disposition, ingredient_rxcui, ingredient_name), one row a string.
    """
    parts = strings.select("source_field", "folded", F.posexplode("components").alias("pos", "component"))
    found = _resolved(parts.select("component").distinct(), exact, approximate, ingredients)
    joined = parts.join(found, "component").groupBy("source_field", "folded").agg(
        F.array_sort(F.collect_list(F.struct("pos", "rxcui", "rank", "score", "approximate", "ingredients"))).alias("m")
    )
    rows = strings.join(joined, ["source_field", "folded"], "left").join(overrides.select("folded", F.struct("disposition", "ingredient_rxcui", "ingredient_name").alias("o")), "folded", "left")
    matched = F.coalesce(F.size("m"), F.lit(0))
    matched = F.when(F.col("m").isNull(), 0).otherwise(matched)
    not_drug, ruled = F.col("o.disposition") == "not_a_drug", F.col("o").isNotNull()
    method = F.when(ruled & not_drug, NOT_A_DRUG).when(ruled, OVERRIDE).when(matched == 0, UNMATCHED).when(F.exists("m", lambda x: x["approximate"]), APPROXIMATE).otherwise(EXACT)
    single = F.size("components") == 1
    one = F.array(F.struct(F.col("o.ingredient_rxcui").alias("ingredient_rxcui"), F.col("o.ingredient_name").alias("ingredient_name"), F.lit("IN").alias("ingredient_tty")))
    none = F.filter(one, lambda _: F.lit(False))
    own = F.when(ruled & not_drug, none).when(ruled, one).when(matched == 0, none).otherwise(F.array_distinct(F.flatten(F.transform("m", lambda x: x["ingredients"]))))
    last = lambda f: F.when(~ruled & (matched > 0), F.try_element_at(F.filter(F.transform("m", lambda x: x[f]), lambda v: v.isNotNull()), F.lit(-1)))
    return rows.select(
        "source_field",
        "folded",
        "cleaned",
        "occurrences",
        "steps",
        method.alias("method"),
        F.when(ruled & ~not_drug, F.col("o.ingredient_rxcui")).when(~ruled & single & (matched > 0), F.col("m")[0]["rxcui"]).alias("rxcui"),
        own.alias("ingredients"),
        last("score").alias("score"),
        last("rank").alias("rank"),
        F.size("components").alias("components_total"),
        F.when(ruled & not_drug, 0).when(ruled, 1).otherwise(matched).alias("components_matched"),
    )


def tables(matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drug_string_match, drug_string_ingredient, drug_concept), made whole from the matches, so writing them twice changes nothing."""
    link = matches.select("source_field", "folded", F.explode("ingredients").alias("i"))
    return (
        matches.drop("ingredients"),
        link.select("source_field", "folded", F.col("i.ingredient_rxcui").alias("rxcui")).distinct(),
        link.groupBy(F.col("i.ingredient_rxcui").alias("rxcui")).agg(F.max("i.ingredient_name").alias("name"), F.max("i.ingredient_tty").alias("tty")),
    )


TABLES = ("drug_string_match", "drug_string_ingredient", "drug_concept")


def store(matches: DataFrame, root: str) -> None:
    """Write the three tables, each as a whole: a string that is gone, or matches anew, leaves nothing behind."""
    matches = written(matches, "matches")
    for name, table in zip(TABLES, tables(matches), strict=True):
        write_whole(table, f"{root}/{name}")


def stored(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables as they were written; one that is missing raises."""
    for name in TABLES:
        if not recovered(spark, f"{root}/{name}"):
            raise NormalizationError(f"{root} has no {name}")
    return tuple(spark.read.parquet(f"{root}/{name}") for name in TABLES)
