"""Disproportionality estimators over 2x2 tables, as Columns. They raise hypotheses; they show no causation."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import np_digamma, np_trigamma

Z = NormalDist().inv_cdf(0.975)
_LN2 = 0.6931471805599453


def z_value(alpha: float = 0.05) -> float:
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")
    return NormalDist().inv_cdf(1 - alpha / 2)


def _cells() -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(x).cast("double") for x in "abcd")


def corrected() -> Column:
    """Whether a cell is zero, so that a half is added to all four."""
    return (F.col("a") == 0) | (F.col("b") == 0) | (F.col("c") == 0) | (F.col("d") == 0)


def _haldane() -> tuple[Column, Column, Column, Column]:
    half = F.when(corrected(), 0.5).otherwise(0.0)
    return tuple(x + half for x in _cells())


def ror(alpha: float = 0.05) -> dict[str, Column]:
    """Reporting odds ratio with its interval on the log scale."""
    a, b, c, d = _haldane()
    log = F.log(a) + F.log(d) - F.log(b) - F.log(c)
    se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    z = F.lit(z_value(alpha))
    return {"ror": F.exp(log), "ror_lower": F.exp(log - z * se), "ror_upper": F.exp(log + z * se)}


def prr(alpha: float = 0.05) -> dict[str, Column]:
    """Proportional reporting ratio with its interval on the log scale."""
    a, b, c, d = _haldane()
    log = F.log(a) - F.log(a + b) - F.log(c) + F.log(c + d)
    se = F.sqrt(F.greatest(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d), F.lit(0.0)))
    z = F.lit(z_value(alpha))
    return {"prr": F.exp(log), "prr_lower": F.exp(log - z * se), "prr_upper": F.exp(log + z * se)}


def chi2() -> Column:
    """Yates' chi-squared of the uncorrected cells; 0 where a margin is empty."""
    a, b, c, d = _cells()
    n = a + b + c + d
    margins = [(a + b, a + c), (a + b, b + d), (c + d, a + c), (c + d, b + d)]
    gap = F.greatest(F.abs(F.try_divide(a * d - b * c, n)) - 0.5, F.lit(0.0))
    total = sum((F.try_divide(n, x * y) for x, y in margins), F.lit(0.0))
    return F.coalesce(gap * gap * total, F.lit(0.0))


def _information(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    """Mean and deviation of the information component of a batch of tables.

    Six gamma functions a row are more code than the JVM compiles in one method; as Columns they ran interpreted.
    """
    a, b, c, d = (x.to_numpy(float) for x in (a, b, c, d))
    n, x, y = a + b + c + d, a + b, a + c
    gamma = (n + 2) * (n + 2) / ((x + 1) * (y + 1))
    total, which = np.unique(n + 2, return_inverse=True)  # one in a population
    psi, psi1 = np_digamma(total)[which], np_trigamma(total)[which]
    ic = (np_digamma(a + 1) - np_digamma(n + gamma) - (np_digamma(x + 1) - psi) - (np_digamma(y + 1) - psi)) / _LN2
    var = (np_trigamma(a + 1) - np_trigamma(n + gamma) + (np_trigamma(x + 1) - psi1) + (np_trigamma(y + 1) - psi1)) / (_LN2 * _LN2)
    return pd.DataFrame({"ic": ic, "sd": np.sqrt(var)})


def bcpnn() -> dict[str, Column]:
    """Information component: mean, lower bounds by two deviations and by the normal quantile, observed over expected."""
    a, b, c, d = _cells()
    n, x, y = a + b + c + d, a + b, a + c
    both = F.pandas_udf(_information, "ic double, sd double")(a, b, c, d)
    ic, sd = both["ic"], both["sd"]
    observed = F.when(F.col("a") == 0, F.lit(float("-inf"))).otherwise(F.log(F.try_divide(n * a, x * y)) / _LN2)
    return {"ic": ic, "ic025": ic - 2 * sd, "ic_observed_expected": observed, "ic025_exact": ic - F.lit(Z) * sd}


def flags(min_a: int = 3) -> dict[str, Column]:
    """The locked thresholds. MGPS and the conjunction of all four are set where ``ebgm05`` is."""
    by = {
        "insufficient": F.col("a") < min_a,
        "flag_ror": (F.col("a") >= 3) & (F.col("ror_lower") > 1),
        "flag_prr": (F.col("chi2") >= 4) & (F.col("prr_lower") > 1),
        "flag_bcpnn": F.col("ic025") > 0,
    }
    by["flag_ror_prr_bcpnn"] = by["flag_ror"] & by["flag_prr"] & by["flag_bcpnn"]
    return by


def score(table: DataFrame, min_a: int = 3) -> DataFrame:
    """The table with ROR, PRR, chi-squared, BCPNN and their flags, in one projection. A negative cell raises."""
    whole = F.assert_true(F.least("a", "b", "c", "d") >= 0, F.lit("a 2x2 table has a negative cell"))
    out = table.filter(whole.isNull()).withColumns({**ror(), **prr(), "chi2": chi2(), **bcpnn(), "corrected": corrected()})
    return out.withColumns(flags(min_a))
