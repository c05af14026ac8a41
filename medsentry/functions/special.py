"""Gamma-family functions: as Column expressions (whole-stage code), as SQL text, and in NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EstimatorConvergenceError

# Recurrence lifts x by 10, where the asymptotic series (Bernoulli numbers) is exact to double precision.
_LIFT = 10


def digamma_sql(x: str) -> str:
    y = f"(({x}) + {_LIFT}.0)"
    down = " - ".join(f"1.0/(({x}) + {k}.0)" for k in range(_LIFT))
    r = f"(1.0/({y}*{y}))"
    return f"(ln({y}) - 0.5/{y} - {r}*(1.0/12.0 - {r}*(1.0/120.0 - {r}*(1.0/252.0 - {r}*(1.0/240.0 - {r}/132.0)))) - {down})"


def trigamma_sql(x: str) -> str:
    y = f"(({x}) + {_LIFT}.0)"
    up = " + ".join(f"1.0/((({x}) + {k}.0)*(({x}) + {k}.0))" for k in range(_LIFT))
    r = f"(1.0/({y}*{y}))"
    return f"(1.0/{y} + 0.5*{r} + {r}/{y}*(1.0/6.0 - {r}*(1.0/30.0 - {r}*(1.0/42.0 - {r}*(1.0/30.0 - {r}*(5.0/66.0))))) + {up})"


def _lifted(x: Column) -> tuple[Column, Column]:
    y = x + F.lit(float(_LIFT))
    return y, F.lit(1.0) / (y * y)


def digamma(x: Column) -> Column:
    y, r = _lifted(x)
    out = F.log(y) - F.lit(0.5) / y - r * (F.lit(1 / 12) - r * (F.lit(1 / 120) - r * (F.lit(1 / 252) - r * (F.lit(1 / 240) - r / F.lit(132.0)))))
    for k in range(_LIFT):
        out = out - F.lit(1.0) / (x + F.lit(float(k)))
    return out


def trigamma(x: Column) -> Column:
    y, r = _lifted(x)
    out = F.lit(1.0) / y + F.lit(0.5) * r + r / y * (F.lit(1 / 6) - r * (F.lit(1 / 30) - r * (F.lit(1 / 42) - r * (F.lit(1 / 30) - r * F.lit(5 / 66)))))
    for k in range(_LIFT):
        out = out + F.lit(1.0) / ((x + F.lit(float(k))) * (x + F.lit(float(k))))
    return out


def lgamma(x: Column) -> Column:
    """Stirling's series at x + 10, less the logs of the steps."""
    y, r = _lifted(x)
    out = (y - 0.5) * F.log(y) - y + F.lit(0.5 * float(np.log(2 * np.pi))) + (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * F.lit(1 / 1680)))) / y
    for k in range(_LIFT):
        out = out - F.log(x + F.lit(float(k)))
    return out


def np_digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y = x + _LIFT
    r = 1 / (y * y)
    return np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - sum(1 / (x + k) for k in range(_LIFT))


def np_trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y = x + _LIFT
    r = 1 / (y * y)
    return 1 / y + 0.5 * r + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * (5 / 66))))) + sum(1 / ((x + k) * (x + k)) for k in range(_LIFT))


def np_lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y = x + _LIFT
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - sum(np.log(x + k) for k in range(_LIFT))


def gammainc(s: np.ndarray, x: np.ndarray, steps: int = 20_000) -> np.ndarray:
    """Regularized lower incomplete gamma function of arrays.

    The power series below x = s + 1, Lentz's continued fraction above. Both take about sqrt(s)
    terms near x = s, and stop where every element has converged; if one doesn't, it raises.
    """
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    out = np.zeros(s.shape)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        front = np.exp(s * np.log(np.where(x > 0, x, 1)) - x - np_lgamma(s))
    low = (x > 0) & (x < s + 1)
    if low.any():
        a, z = s[low], x[low]
        total = step = 1 / a
        for n in range(1, steps):
            step = step * z / (a + n)
            total = total + step
            if (step < total * 1e-16).all():
                break
        else:
            raise EstimatorConvergenceError("the incomplete gamma series did not converge")
        out[low] = total * front[low]
    high = x >= s + 1
    if high.any():
        a, z, tiny = s[high], x[high], 1e-300
        b = z + 1 - a
        c, d = np.full_like(b, 1 / tiny), 1 / b
        h = d.copy()
        for n in range(1, steps):
            an = -n * (n - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            h = h * delta
            if (np.abs(delta - 1) < 1e-15).all():
                break
        else:
            raise EstimatorConvergenceError("the incomplete gamma fraction did not converge")
        out[high] = 1 - front[high] * h
    return np.clip(out, 0, 1)
