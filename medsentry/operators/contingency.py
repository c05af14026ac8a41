"""2x2 tables of every observed (drug, event) pair over the deduplicated population.

Inputs are made distinct before they meet, margins are counted apart from the pairs, and the cells
without reports follow by inclusion and exclusion; pairs never reported are never made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContingencyError
from ..functions.text import fold
from ..storage import written
from .dedup import in_quarters

ROLES = {"ps_ss": ("PS", "SS"), "ps": ("PS",)}
KEYS = ("ingredient", "raw_string")


@dataclass(frozen=True)
class Spec:
    """What decides the meaning of the numbers; recorded with every run. ``min_a`` flags and never filters."""

    drug_key: str = "ingredient"
    roles: str = "ps_ss"
    min_a: int = 3
    start_quarter: str | None = None
    end_quarter: str | None = None

    def __post_init__(self):
        if self.drug_key not in KEYS or self.roles not in ROLES:
            raise ContingencyError(f"unknown drug key or roles: {self.drug_key}, {self.roles}")

    def params(self) -> dict[str, str | int | None]:
        return {"drug_key": self.drug_key, "roles": self.roles, "role_codes": ",".join(ROLES[self.roles]), "min_a": self.min_a, "start_quarter": self.start_quarter, "end_quarter": self.end_quarter}


def population(cases: DataFrame, duplicates: DataFrame, spec: Spec = Spec()) -> DataFrame:  # noqa: B008
    """The primaryids of the range, each once, without the duplicates."""
    return in_quarters(cases, spec.start_quarter, spec.end_quarter).select("primaryid").distinct().join(duplicates.select("primaryid"), "primaryid", "left_anti")


def _term(name: str) -> Column:
    return F.upper(F.trim(F.col(name)))


def _given(name: str) -> Column:
    return F.col(name).isNotNull() & (F.trim(name) != "")


def raw_drugs(drugs: DataFrame, spec: Spec) -> DataFrame:
    """(primaryid, drug) by the reported string."""
    return drugs.filter(F.col("role_cod").isin(*ROLES[spec.roles]) & _given("drugname_raw")).select("primaryid", _term("drugname_raw").alias("drug"))


def ingredient_drugs(drugs: DataFrame, matches: DataFrame, associations: DataFrame, concepts: DataFrame, spec: Spec) -> DataFrame:
    """(primaryid, drug) by ingredient name.

    A match says which field its folded string comes from, so the join's key would depend on the
    map's row. It is written as a join for each field, which Spark can hash.
    """
    for name, df in (("drug_string_match", matches), ("drug_string_ingredient", associations), ("drug_concept", concepts)):
        if not df.limit(1).count():
            raise ContingencyError(f"{name} is empty; run the normalization before counting by ingredient")
    names = matches.select("source_field", "folded").join(associations, ["source_field", "folded"]).join(concepts, "rxcui").select("source_field", "folded", _term("name").alias("drug"))
    own = drugs.filter(F.col("role_cod").isin(*ROLES[spec.roles]))
    out = None
    for field in ("prod_ai", "drugname_raw"):
        part = own.filter(_given(field)).select("primaryid", fold(F.col(field)).alias("folded")).join(names.filter(F.col("source_field") == field), "folded").select("primaryid", "drug")
        out = part if out is None else out.unionByName(part)
    return out


def case_terms(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Distinct (case, term) rows of the population."""
    return rows.join(people, "primaryid", "left_semi").distinct()


def pair_table(drugs: DataFrame, reactions: DataFrame, people: DataFrame) -> DataFrame:
    """drug, pt, a, b, c, d, n_cases, expected for every observed pair.

    ``drugs``: (primaryid, drug); ``reactions``: (primaryid, pt). An empty population raises.
    """
    n = people.count()
    if not n:
        raise ContingencyError("no case is left in the population")
    cd = case_terms(drugs, people)
    cr = case_terms(reactions.filter(_given("pt")).select("primaryid", _term("pt").alias("pt")), people)
    pairs = cd.join(cr, "primaryid").groupBy("drug", "pt").agg(F.count("*").alias("a"))
    by_drug = cd.groupBy("drug").agg(F.count("*").alias("n_drug"))
    by_pt = cr.groupBy("pt").agg(F.count("*").alias("n_pt"))
    out = pairs.join(by_drug, "drug").join(by_pt, "pt")
    cells = {"b": F.col("n_drug") - F.col("a"), "c": F.col("n_pt") - F.col("a"), "d": F.lit(n) - F.col("n_drug") - F.col("n_pt") + F.col("a"), "n_cases": F.lit(n).cast("bigint")}
    expected = F.col("n_drug").cast("double") * F.col("n_pt") / F.lit(float(n))
    return out.withColumns(cells).withColumn("expected", expected).select("drug", "pt", "a", "b", "c", "d", "n_cases", "expected")


def ordered(table: DataFrame) -> DataFrame:
    """For reading: the most frequent pairs first, equal ones by drug and term."""
    return table.orderBy(F.desc("a"), "drug", "pt")


def violations(table: DataFrame) -> DataFrame:
    """One row: pairs, those with a negative cell, and those whose cells don't add up to the population."""
    total = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return table.agg(F.count("*").alias("pairs"), F.count_if(F.least("a", "b", "c", "d") < 0).alias("negative"), F.count_if(total != F.col("n_cases")).alias("unequal"))


def build(cases: DataFrame, drugs: DataFrame, reactions: DataFrame, duplicates: DataFrame, spec: Spec = Spec(), normalized: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:  # noqa: B008
    """The pair table of a specification. Counting by ingredient needs the three normalization tables."""
    people = written(population(cases, duplicates, spec), "population")  # it is used three times
    if spec.drug_key == "raw_string":
        named = raw_drugs(drugs, spec)
    elif normalized is None:
        raise ContingencyError("counting by ingredient needs the normalization tables")
    else:
        named = ingredient_drugs(drugs, *normalized, spec)
    return pair_table(named, reactions, people)
