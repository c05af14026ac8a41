"""Declared columns of the source tables in each era, and of the stored datasets.

The era follows from the quarter and is never guessed from a file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from ..errors import SchemaMismatchError
from .quarter import Quarter

TABLES = ("DEMO", "DRUG", "INDI", "OUTC", "REAC", "RPSR", "THER")
ERAS = ("2012q4_only", "pre_2014q3", "2014q3_onward")

# The published column orders.
_COLUMNS = {
    ("DEMO", "2012q4_only"): (
        "primaryid", "caseid", "caseversion", "i_f_code", "event_dt", "mfr_dt", "init_fda_dt", "fda_dt", "rept_cod", "mfr_num", "mfr_sndr", "age",
        "age_cod", "gndr_cod", "e_sub", "wt", "wt_cod", "rept_dt", "to_mfr", "occp_cod", "reporter_country", "occr_country",
    ),
    ("DEMO", "pre_2014q3"): (
        "primaryid", "caseid", "caseversion", "i_f_code", "event_dt", "mfr_dt", "init_fda_dt", "fda_dt", "rept_cod", "mfr_num", "mfr_sndr", "age",
        "age_cod", "gndr_cod", "e_sub", "wt", "wt_cod", "rept_dt", "to_mfr", "occp_cod", "reporter_country", "occr_country",
    ),
    ("DEMO", "2014q3_onward"): (
        "primaryid", "caseid", "caseversion", "i_f_code", "event_dt", "mfr_dt", "init_fda_dt", "fda_dt", "rept_cod", "auth_num", "mfr_num",
        "mfr_sndr", "lit_ref", "age", "age_cod", "age_grp", "sex", "e_sub", "wt", "wt_cod", "rept_dt", "to_mfr", "occp_cod", "reporter_country",
        "occr_country",
    ),
    ("DRUG", "2012q4_only"): (
        "primaryid", "caseid", "drug_seq", "role_cod", "drugname", "val_vbm", "route", "dose_vbm", "cum_dose_chr", "cum_dose_unit", "dechal",
        "rechal", "lot_nbr", "exp_dt", "nda_num", "dose_amt", "dose_unit", "dose_form", "dose_freq",
    ),
    ("DRUG", "pre_2014q3"): (
        "primaryid", "caseid", "drug_seq", "role_cod", "drugname", "val_vbm", "route", "dose_vbm", "cum_dose_chr", "cum_dose_unit", "dechal",
        "rechal", "lot_num", "exp_dt", "nda_num", "dose_amt", "dose_unit", "dose_form", "dose_freq",
    ),
    ("DRUG", "2014q3_onward"): (
        "primaryid", "caseid", "drug_seq", "role_cod", "drugname", "prod_ai", "val_vbm", "route", "dose_vbm", "cum_dose_chr", "cum_dose_unit",
        "dechal", "rechal", "lot_num", "exp_dt", "nda_num", "dose_amt", "dose_unit", "dose_form", "dose_freq",
    ),
    ("INDI", "2012q4_only"): (
        "primaryid", "caseid", "indi_drug_seq", "indi_pt",
    ),
    ("INDI", "pre_2014q3"): (
        "primaryid", "caseid", "indi_drug_seq", "indi_pt",
    ),
    ("INDI", "2014q3_onward"): (
        "primaryid", "caseid", "indi_drug_seq", "indi_pt",
    ),
    ("OUTC", "2012q4_only"): (
        "primaryid", "caseid", "outc_code",
    ),
    ("OUTC", "pre_2014q3"): (
        "primaryid", "caseid", "outc_cod",
    ),
    ("OUTC", "2014q3_onward"): (
        "primaryid", "caseid", "outc_cod",
    ),
    ("REAC", "2012q4_only"): (
        "primaryid", "caseid", "pt",
    ),
    ("REAC", "pre_2014q3"): (
        "primaryid", "caseid", "pt",
    ),
    ("REAC", "2014q3_onward"): (
        "primaryid", "caseid", "pt", "drug_rec_act",
    ),
    ("RPSR", "2012q4_only"): (
        "primaryid", "caseid", "rpsr_cod",
    ),
    ("RPSR", "pre_2014q3"): (
        "primaryid", "caseid", "rpsr_cod",
    ),
    ("RPSR", "2014q3_onward"): (
        "primaryid", "caseid", "rpsr_cod",
    ),
    ("THER", "2012q4_only"): (
        "primaryid", "caseid", "dsg_drug_seq", "start_dt", "end_dt", "dur", "dur_cod",
    ),
    ("THER", "pre_2014q3"): (
        "primaryid", "caseid", "dsg_drug_seq", "start_dt", "end_dt", "dur", "dur_cod",
    ),
    ("THER", "2014q3_onward"): (
        "primaryid", "caseid", "dsg_drug_seq", "start_dt", "end_dt", "dur", "dur_cod",
    ),
}
# Columns that are known by another name from here on.
_RENAMED = {
    "event_dt": "event_dt_raw",
    "mfr_dt": "mfr_dt_raw",
    "init_fda_dt": "init_fda_dt_raw",
    "fda_dt": "fda_dt_raw",
    "gndr_cod": "sex",
    "rept_dt": "rept_dt_raw",
    "drugname": "drugname_raw",
    "lot_nbr": "lot_num",
    "exp_dt": "exp_dt_raw",
    "outc_code": "outc_cod",
    "start_dt": "start_dt_raw",
    "end_dt": "end_dt_raw",
}
# Numeric columns; all others are text.
_LONG = {"primaryid", "caseid", "caseversion", "drug_seq", "indi_drug_seq", "dsg_drug_seq"}
_DOUBLE = {"age", "wt", "dur"}

#: Stored datasets.
DATASETS = {
    "case": T.StructType(
        [
            T.StructField("primaryid", T.LongType()),
            T.StructField("caseid", T.LongType()),
            T.StructField("caseversion", T.LongType()),
            T.StructField("quarter", T.StringType()),
            T.StructField("fda_dt", T.DateType()),
            T.StructField("fda_dt_raw", T.StringType()),
            T.StructField("fda_dt_precision", T.StringType()),
            T.StructField("event_dt", T.DateType()),
            T.StructField("event_dt_raw", T.StringType()),
            T.StructField("event_dt_precision", T.StringType()),
            T.StructField("sex", T.StringType()),
            T.StructField("age_years", T.DoubleType()),
            T.StructField("weight_kg", T.DoubleType()),
            T.StructField("country", T.StringType()),
            T.StructField("country_source", T.StringType()),
            T.StructField("occp_cod", T.StringType()),
            T.StructField("serious", T.BooleanType()),
            T.StructField("serious_death", T.BooleanType()),
            T.StructField("outcome_codes", T.ArrayType(T.StringType())),
        ]
    ),
    "drug": T.StructType(
        [
            T.StructField("primaryid", T.LongType()),
            T.StructField("drug_seq", T.LongType()),
            T.StructField("role_cod", T.StringType()),
            T.StructField("drugname_raw", T.StringType()),
            T.StructField("prod_ai", T.StringType()),
            T.StructField("route", T.StringType()),
        ]
    ),
    "reaction": T.StructType(
        [
            T.StructField("primaryid", T.LongType()),
            T.StructField("pt", T.StringType()),
            T.StructField("drug_rec_act", T.StringType()),
        ]
    ),
    "outcome": T.StructType(
        [
            T.StructField("primaryid", T.LongType()),
            T.StructField("outc_cod", T.StringType()),
        ]
    ),
    "therapy": T.StructType(
        [
            T.StructField("primaryid", T.LongType()),
            T.StructField("dsg_drug_seq", T.LongType()),
            T.StructField("start_dt", T.DateType()),
            T.StructField("start_dt_raw", T.StringType()),
            T.StructField("start_dt_precision", T.StringType()),
            T.StructField("end_dt", T.DateType()),
            T.StructField("end_dt_raw", T.StringType()),
            T.StructField("end_dt_precision", T.StringType()),
            T.StructField("dur_days", T.DoubleType()),
        ]
    ),
    "indication": T.StructType(
        [
            T.StructField("primaryid", T.LongType()),
            T.StructField("indi_drug_seq", T.LongType()),
            T.StructField("indi_pt", T.StringType()),
        ]
    ),
    "report_source": T.StructType(
        [
            T.StructField("primaryid", T.LongType()),
            T.StructField("rpsr_cod", T.StringType()),
        ]
    ),
}
TABLE_OF = {"case": "DEMO", "drug": "DRUG", "reaction": "REAC", "outcome": "OUTC", "therapy": "THER", "indication": "INDI", "report_source": "RPSR"}


@dataclass(frozen=True)
class Field:
    source: str
    name: str
    kind: T.DataType


def _field(source: str) -> Field:
    kind = T.LongType() if source in _LONG else T.DoubleType() if source in _DOUBLE else T.StringType()
    return Field(source, _RENAMED.get(source, source), kind)


SOURCE = {key: tuple(_field(c) for c in columns) for key, columns in _COLUMNS.items()}


def era(quarter: Quarter) -> str:
    if quarter < Quarter(2013, 1):
        return ERAS[0]
    return ERAS[1] if quarter < Quarter(2014, 3) else ERAS[2]


def source_fields(table: str, quarter: Quarter) -> tuple[Field, ...]:
    return SOURCE[table, era(quarter)]


def check_header(table: str, quarter: Quarter, header: list[str]) -> None:
    """Raise unless the trimmed header has exactly the declared names in their order."""
    found, wanted = [h.strip().lstrip("﻿") for h in header], [f.source for f in source_fields(table, quarter)]
    if found == wanted:
        return
    missing, extra = [w for w in wanted if w not in found], [f for f in found if f not in wanted]
    said = [f"missing {missing}"] * bool(missing) + [f"unexpected {extra}"] * bool(extra) or [f"another order: {found}, not {wanted}"]
    raise SchemaMismatchError(f"{quarter} {table} ({era(quarter)}): {'; '.join(said)}")
