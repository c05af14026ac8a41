"""Scalar functions over text and units, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years in an age unit, kilograms in a weight unit, and the bounds of plausible values.
AGE_UNIT_YEARS = {"DEC": 10.0, "YR": 1.0, "MON": 1.0 / 12.0, "WK": 1.0 / 52.1775, "DY": 1.0 / 365.25, "HR": 1.0 / 8766.0, "MIN": 1.0 / 525960.0, "SEC": 1.0 / 31557600.0}
WEIGHT_UNIT_KG = {"KG": 1.0, "LBS": 0.45359237, "GMS": 0.001}
MAX_AGE_YEARS, MAX_WEIGHT_KG = 120.0, 650.0
UNKNOWN_COUNTRIES = ("COUNTRY NOT SPECIFIED",)
PRECISIONS = {8: "day", 6: "month", 4: "year"}

# Java's \s is ASCII only unless (?U) is on.
_BLANK = r"(?U)\s+"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def fold(x: Column) -> Column:
    """Runs of white space become one space, none at the ends, upper case."""
    return F.upper(F.trim(F.regexp_replace(x, _BLANK, " ")))


def term(x: Column) -> Column:
    """A folded term; blank is null."""
    return blank_to_null(fold(x))


def sex(x: Column) -> Column:
    return blank_to_null(F.upper(strip(x)))


def country(x: Column) -> Column:
    """Trimmed and upper case; blank, and words that say it is unknown, are null."""
    name = F.upper(strip(x))
    return F.when((name != "") & ~name.isin(*UNKNOWN_COUNTRIES), name)


def _units(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(v) for kv in factors.items() for v in kv])
    return strip(value).try_cast("double") * F.try_element_at(table, strip(unit))


def age_in_years(value: Column, unit: Column) -> Column:
    """Null without a number, a known unit, or a result from 0 to 120."""
    years = _units(value, unit, AGE_UNIT_YEARS)
    return F.when(years.between(0, MAX_AGE_YEARS), years)


def weight_in_kg(value: Column, unit: Column) -> Column:
    """Null without a number, a known unit, or a result between 0 and 650, both excluded."""
    kg = _units(value, unit, WEIGHT_UNIT_KG)
    return F.when((kg > 0) & (kg < MAX_WEIGHT_KG), kg)


def date_precision(x: Column) -> Column:
    n = F.length(strip(x))
    out = F.lit("missing")
    for length, name in PRECISIONS.items():
        out = F.when(n == length, name).otherwise(out)
    return out


def partial_date(x: Column) -> Column:
    """The first day of a day, month or year; null if there is no such date."""
    own = strip(x)
    full = F.when(F.length(own) == 8, own).when(F.length(own) == 6, F.concat(own, F.lit("01"))).when(F.length(own) == 4, F.concat(own, F.lit("0101")))
    return F.when(full.rlike("^[0-9]{8}$"), F.try_to_date(full, "yyyyMMdd"))


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    """A rounded ratio, 0 for an empty whole."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits), F.lit(0.0))
