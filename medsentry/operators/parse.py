"""Parsing of the source tables: all-text rows in, typed rows of the stored datasets out.

Casts never raise; what they lose is counted. Each table has a parse function and named conditions
over its raw rows; ``tally`` counts all of a table's conditions in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IngestError
from ..functions import text as t
from ..sources.schema import DATASETS


def _long(name: str) -> Column:
    return F.col(name).try_cast("bigint").alias(name)


def _given(x: Column) -> Column:
    return F.coalesce(t.strip(x) != "", F.lit(False))


def check_age_units(raw: DataFrame) -> None:
    """Raise if a unit isn't one of the known ones: the source has changed, and ages would vanish unseen."""
    unit = t.strip(F.col("age_cod"))
    odd = raw.select(unit.alias("u")).filter((F.col("u") != "") & ~F.col("u").isin(*t.AGE_UNIT_YEARS)).distinct().limit(20).collect()
    if odd:
        raise IngestError(f"unknown age units: {sorted(r.u for r in odd)}")


def with_dates(df: DataFrame, *names: str) -> DataFrame:
    """A raw date becomes a triple: the raw text, the first day it can mean, its precision."""
    return df.withColumns({k: v for n in names for k, v in ((n, t.partial_date(F.col(f"{n}_raw"))), (f"{n}_precision", t.date_precision(F.col(f"{n}_raw"))))})


def demo(raw: DataFrame) -> DataFrame:
    occurred, reported = t.country(F.col("occr_country")), t.country(F.col("reporter_country"))
    out = raw.withColumns(
        {
            "primaryid": _long("primaryid"),
            "caseid": _long("caseid"),
            "caseversion": _long("caseversion"),
            "age_years": t.age_in_years(F.col("age"), F.col("age_cod")),
            "weight_kg": t.weight_in_kg(F.col("wt"), F.col("wt_cod")),
            "sex": t.sex(F.col("sex")),
            "country": F.coalesce(occurred, reported),
            "country_source": F.when(occurred.isNotNull(), "occurrence").when(reported.isNotNull(), "reporter").otherwise("none"),
        }
    )
    return with_dates(out, "event_dt", "fda_dt", "init_fda_dt", "mfr_dt", "rept_dt")


def _lost_date(name: str) -> Column:
    return (t.date_precision(F.col(name)) != "missing") & t.partial_date(F.col(name)).isNull()


def conditions(table: str) -> dict[str, Column]:
    """The named conditions over a source table's raw rows; empty for tables that only cast ids."""
    c, term = F.col, t.term
    if table == "DEMO":
        occurred, reported = t.country(c("occr_country")), t.country(c("reporter_country"))
        bad_unit = _given(c("wt_cod")) & ~t.strip(c("wt_cod")).isin(*t.WEIGHT_UNIT_KG)
        return {
            "age_missing_or_unconvertible": _given(c("age")) & t.age_in_years(c("age"), c("age_cod")).isNull(),
            "weight_missing_or_unconvertible": _given(c("wt")) & t.weight_in_kg(c("wt"), c("wt_cod")).isNull() & ~bad_unit,
            "weight_implausible_unit": bad_unit,
            "sex_missing": t.sex(c("sex")).isNull(),
            "country_missing": occurred.isNull() & reported.isNull(),
            "country_from_reporter_fallback": occurred.isNull() & reported.isNotNull(),
            "country_stated_unknown": F.coalesce(F.upper(t.strip(c("occr_country"))).isin(*t.UNKNOWN_COUNTRIES), F.lit(False)),
            "event_dt_unparseable": _lost_date("event_dt_raw"),
        }
    return {
        "REAC": lambda: {"pt_missing": c("pt").isNotNull() & term(c("pt")).isNull()},
        "DRUG": lambda: {"drugname_missing": term(c("drugname_raw")).isNull(), "prod_ai_absent": term(c("prod_ai")).isNull()},
        "THER": lambda: {f"{d}_unparseable": _lost_date(f"{d}_raw") for d in ("start_dt", "end_dt")},
        "INDI": lambda: {"indi_pt_missing": c("indi_pt").isNotNull() & term(c("indi_pt")).isNull()},
    }.get(table, dict)()


def tally(raw: DataFrame, table: str) -> DataFrame:
    """One row: how many raw rows meet each of the table's conditions, and how many rows there are."""
    if table == "DRUG" and "prod_ai" not in raw.columns:
        raw = raw.withColumn("prod_ai", F.lit(None).cast("string"))
    return raw.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in conditions(table).items()))


def drug(raw: DataFrame) -> DataFrame:
    """Before 2014Q3 there is no ``prod_ai``; the column is null then."""
    if "prod_ai" not in raw.columns:
        raw = raw.withColumn("prod_ai", F.lit(None).cast("string"))
    return raw.withColumns({"primaryid": _long("primaryid"), "caseid": _long("caseid"), "drug_seq": _long("drug_seq"), "role_cod": F.upper(t.strip(F.col("role_cod"))), "drugname_norm": t.term(F.col("drugname_raw")), "prod_ai": t.term(F.col("prod_ai"))})


def reaction(raw: DataFrame) -> DataFrame:
    if "drug_rec_act" not in raw.columns:
        raw = raw.withColumn("drug_rec_act", F.lit(None).cast("string"))
    return raw.withColumns({"primaryid": _long("primaryid"), "caseid": _long("caseid"), "pt": t.term(F.col("pt"))})


def therapy(raw: DataFrame) -> DataFrame:
    """``dur_days`` is the reported number whatever its unit; ``dur_cod`` has the unit."""
    out = raw.withColumns({"primaryid": _long("primaryid"), "caseid": _long("caseid"), "dsg_drug_seq": _long("dsg_drug_seq"), "dur_days": F.col("dur").try_cast("double")})
    return with_dates(out, "start_dt", "end_dt")


def indication(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"primaryid": _long("primaryid"), "caseid": _long("caseid"), "indi_drug_seq": _long("indi_drug_seq"), "indi_pt": t.term(F.col("indi_pt"))})


def outcome(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"primaryid": _long("primaryid"), "caseid": _long("caseid")})


PARSERS = {"DEMO": demo, "DRUG": drug, "REAC": reaction, "THER": therapy, "INDI": indication, "OUTC": outcome, "RPSR": outcome}


def seriousness(outcomes: DataFrame) -> DataFrame:
    """By case: any outcome row makes it serious, a DE row a death; the codes sorted, without nulls."""
    return outcomes.groupBy("primaryid").agg(F.array_sort(F.collect_set("outc_cod")).alias("outcome_codes"), F.coalesce(F.bool_or(F.col("outc_cod") == "DE"), F.lit(False)).alias("serious_death"), F.lit(True).alias("serious"))


def attach_seriousness(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Cases without an outcome row are not serious and have no codes."""
    out = cases.join(seriousness(outcomes), "primaryid", "left")
    return out.withColumns({"serious": F.coalesce("serious", F.lit(False)), "serious_death": F.coalesce("serious_death", F.lit(False)), "outcome_codes": F.coalesce("outcome_codes", F.array().cast("array<string>"))})


def latest_versions(cases: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """One row a case id, of the highest version (then primaryid), without the withdrawn case ids.

    Rows without a case id are one case; a withdrawal list never removes them.
    """
    if withdrawn is not None:
        cases = cases.join(withdrawn.select("caseid").distinct(), "caseid", "left_anti")
    # A max over structs: each task reduces its rows first, so the rows without a case id don't meet in one task.
    order = F.struct(F.col("caseversion").isNotNull().alias("has_version"), "caseversion", F.col("primaryid").isNotNull().alias("has_id"), "primaryid", F.struct(*cases.columns).alias("row"))
    return cases.groupBy(F.col("caseid").alias("_case")).agg(F.max(order).alias("_best")).select("_best.row.*")


def surviving(child: DataFrame, cases: DataFrame) -> DataFrame:
    return child.join(cases.select("primaryid"), "primaryid", "left_semi")


def dataset(parsed: DataFrame, name: str) -> DataFrame:
    """The stored columns of a dataset, in their order; absent ones are null."""
    return parsed.select(*(F.col(f.name).cast(f.dataType) if f.name in parsed.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in DATASETS[name]))
