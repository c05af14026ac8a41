"""Gamma-Poisson shrinkage: squashing, fitting and scoring in Spark.

The zero-truncated likelihood depends on a pair only through its count and expected count, so
millions of pairs become weighted points. Their likelihood and its derivatives are sums over batches
of points, so of each step of a fit six numbers a search reach the driver, however many points there
are. Searches begin where a coarse grid of the points, of bounded size, has its optimum and curvature.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EstimatorConvergenceError
from ..functions.special import digamma, gammainc, lgamma, np_digamma, np_lgamma
from ..storage import written

# Names, bounds and starts of the fit, and the squashing.
NAMES = ("alpha1", "beta1", "alpha2", "beta2", "p")
LOW = np.array([1e-6, 1e-6, 1e-6, 1e-6, 1e-6])
HIGH = np.array([1e4, 1e4, 1e4, 1e4, 1 - 1e-6])
STARTS = ((0.2, 0.1, 2.0, 4.0, 1 / 3), (0.5, 0.5, 2.0, 2.0, 0.1), (1.0, 1.0, 3.0, 3.0, 0.2), (2.0, 0.5, 2.0, 2.0, 0.1))
BIN, KEEP, MIN_BINS, SQUASH_FROM = 300, 10, 50, 100_000
#: Cells an octave of the coarse grid. Counts and expected counts of 60 octaves make 230,000 cells at most; real tables fill some thousands.
OCTAVE = 8
BISECTIONS, CEILING = 100, 1e18


@dataclass(frozen=True)
class Prior:
    alpha1: float
    beta1: float
    alpha2: float
    beta2: float
    p: float
    nll: float = float("nan")
    iterations: int = 0
    n_pairs: int = 0
    n_fitted_rows: int = 0
    on_boundary: tuple[str, ...] = ()

    @property
    def theta(self) -> np.ndarray:
        return np.array([self.alpha1, self.beta1, self.alpha2, self.beta2, self.p])

    @property
    def provisional(self) -> bool:
        return bool(self.on_boundary)


def squash(table: DataFrame, bin_size: int = BIN, keep: int = KEEP, min_bins: int = MIN_BINS) -> DataFrame:
    """(a, expected, weight): per count, the largest expected counts singly and the rest in bins of ``bin_size``.

    Strata below ``keep + bin_size * min_bins`` rows stay as they are. Equal (a, expected) are counted
    first and take a run of ranks, so pairs with equal margins don't meet in one task. The count a = 1
    has most of all pairs, so rows are not ranked by one window over a stratum: they are
    range-partitioned by (a, expected) and numbered within each range, and the ranges' sizes, of
    which there are as many as partitions, give each range its first rank.
    """
    if bin_size < 1 or keep < 0:
        raise ValueError(f"bin_size {bin_size} and keep {keep} make no squashing")
    counted = table.groupBy(F.col("a").cast("double").alias("a"), "expected").agg(F.count("*").alias("n"))
    ranged = written(counted.repartitionByRange("a", "expected").withColumn("part", F.spark_partition_id()), "squash")
    within = ranged.withColumn("before", F.sum("n").over(Window.partitionBy("part", "a").orderBy("expected")) - F.col("n"))
    sizes = ranged.groupBy("part", "a").agg(F.sum("n").alias("m"))
    first = sizes.withColumn("first", F.coalesce(F.sum("m").over(Window.partitionBy("a").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("m").over(Window.partitionBy("a"))).drop("m")
    # Ranks low + 1 .. high; those up to ``cut`` are binned, the others stand alone.
    rows = within.join(first, ["part", "a"]).withColumn("low", F.col("first") + F.col("before")).withColumn("high", F.col("low") + F.col("n"))
    rows = rows.withColumn("cut", F.when(F.col("size") < keep + bin_size * min_bins, 0).otherwise(F.col("size") - keep))
    binned = rows.filter("low < cut").withColumn("g", F.explode(F.expr(f"sequence(low div {bin_size}, (least(high, cut) - 1) div {bin_size})")))
    share = F.least("high", "cut", (F.col("g") + 1) * bin_size) - F.greatest("low", F.col("g") * bin_size)
    bins = binned.groupBy("a", "g").agg((F.sum(F.col("expected") * share) / F.sum(share)).alias("expected"), F.sum(share).cast("double").alias("weight"))
    alone = rows.filter("high > cut").select("a", "expected", F.explode(F.expr("sequence(greatest(low, cut) + 1, high)")).alias("rank"))
    return bins.select("a", "expected", "weight").unionByName(alone.select("a", "expected", F.lit(1.0).alias("weight")))


def _log_parts(theta: np.ndarray, n: np.ndarray, e: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None = None):
    """Log densities of both truncated components and their gradients in shape and rate.

    Counts are few distinct integers, so gamma functions are taken once for each of them.
    """
    out = []
    distinct, which = same or np.unique(n, return_inverse=True)
    fact = np_lgamma(distinct + 1)
    for shape, rate in (theta[0:2], theta[2:4]):
        of_n = (np_lgamma(distinct + shape) - np_lgamma(shape) - fact)[which]
        psi_n = (np_digamma(distinct + shape) - np_digamma(shape))[which]
        log_sum = np.log(rate + e)
        log_p, log_q = np.log(rate) - log_sum, np.log(e) - log_sum
        log_zero = shape * log_p
        survive = np.maximum(-np.expm1(log_zero), 1e-300)
        f = of_n + log_zero + n * log_q - np.log(survive)
        odds = np.exp(log_zero) / survive
        by_shape = psi_n + log_p + odds * log_p
        slope = e / (rate * (rate + e))  # of log_p in the rate
        by_rate = shape * slope - n / (rate + e) + odds * shape * slope
        out.append((f, by_shape, by_rate))
    return out


def nll(theta: np.ndarray, n: np.ndarray, e: np.ndarray, w: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[float, np.ndarray]:
    """Weighted zero-truncated negative log-likelihood and its gradient."""
    (f1, s1, r1), (f2, s2, r2) = _log_parts(theta, n, e, same)
    p = theta[4]
    l1, l2 = np.log(p) + f1, np.log1p(-p) + f2
    total = np.logaddexp(l1, l2)
    u1, u2 = np.exp(l1 - total), np.exp(l2 - total)
    grad = np.array([(w * u1 * s1).sum(), (w * u1 * r1).sum(), (w * u2 * s2).sum(), (w * u2 * r2).sum(), (w * (u1 / p - u2 / (1 - p))).sum()])
    return -float((w * total).sum()), -grad


def log_likelihood(table: DataFrame, prior: Prior, weight: str | None = None) -> DataFrame:
    """One row (pairs, log_likelihood) of a table (a, expected) under a prior, truncated at zero, without leaving Spark."""
    a, e = F.col("a").cast("double"), F.col("expected")

    def part(shape: float, rate: float) -> Column:
        log_sum = F.log(e + rate)
        log_p = F.lit(float(np.log(rate))) - log_sum
        of_a = lgamma(a + shape) - F.lit(float(np_lgamma(np.array([shape]))[0])) - lgamma(a + 1)
        return of_a + log_p * shape + a * (F.log(e) - log_sum) - F.log(-F.expm1(log_p * shape))

    parts = table.select(F.lit(1.0).alias("w") if weight is None else F.col(weight).alias("w"), (F.lit(float(np.log(prior.p))) + part(prior.alpha1, prior.beta1)).alias("l1"), (F.lit(float(np.log1p(-prior.p))) + part(prior.alpha2, prior.beta2)).alias("l2"))
    high = F.greatest("l1", "l2")
    return parts.agg(F.sum("w").cast("bigint").alias("pairs"), F.sum(F.col("w") * (high + F.log1p(F.exp(F.least("l1", "l2") - high)))).alias("log_likelihood"))


def derivatives(table: DataFrame, thetas: list[np.ndarray], weight: str | None = None) -> DataFrame:
    """A row a theta (k): pairs, log_likelihood and its five derivatives (by_alpha1 ...) of a table (a, expected), truncated at zero.

    A batch of rows becomes one row for each theta inside the task, and those are summed. As Columns the gamma
    functions made one method that is too large for the JVM to compile.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                n, e, w = (rows[c].to_numpy(float) for c in ("a", "e", "w"))
                same = np.unique(n, return_inverse=True)
                found = [nll(t, n, e, w, same) for t in thetas]
                yield pd.DataFrame([(k, w.sum(), -v, *-g) for k, (v, g) in enumerate(found)], columns=["k", "pairs", "log_likelihood", *slopes])

    slopes = [f"by_{n}" for n in NAMES]
    weighted = F.lit(1.0) if weight is None else F.col(weight)
    rows = table.select(F.col("a").cast("double").alias("a"), F.col("expected").alias("e"), weighted.alias("w"))
    parts = rows.mapInPandas(sums, "k int, pairs double, log_likelihood double, " + ", ".join(f"{x} double" for x in slopes))
    return parts.groupBy("k").agg(F.sum("pairs").cast("bigint").alias("pairs"), *(F.sum(x).alias(x) for x in ("log_likelihood", *slopes)))


#: What a search asks for (some thetas), what it is told (value and gradient of each), and its end: (theta, value, iterations, converged).
Search = Generator[list[np.ndarray], list[tuple[float, np.ndarray]], tuple[np.ndarray, float, int, bool]]


def _to(x: np.ndarray) -> np.ndarray:
    return np.append(np.log(x[:4]), np.log(x[4] / (1 - x[4])))


def _back(y: np.ndarray) -> np.ndarray:
    return np.append(np.exp(y[:4]), 1 / (1 + np.exp(-y[4])))


def search(start: np.ndarray, fixed: np.ndarray | None = None, steps: int = 500, curvature: Callable[[np.ndarray], np.ndarray] | None = None, fan: int = 1, still: float = 1e-11) -> Search:
    """Bounded quasi-Newton search in log (and, for p, logit) coordinates.

    The coordinates make the scales alike; a step is projected on the bounds, and coordinates held at a
    bound by their gradient leave the quasi-Newton update until it turns. ``curvature`` gives second
    derivatives at a theta, in these coordinates: with it the steps are Newton's, with its directions of
    no or negative curvature turned downhill. ``fan`` step lengths are asked for at once. A step that
    gains a share of ``still`` or less is the last one.
    """
    to, back = _to, _back
    lo, hi = to(LOW), to(HIGH)
    hold = np.zeros(5, bool) if fixed is None else fixed

    def at(*ys):
        xs = [np.clip(back(y), LOW, HIGH) for y in ys]
        told = yield xs
        return [(v, np.where(hold, 0, g * np.append(x[:4], x[4] * (1 - x[4])))) for x, (v, g) in zip(xs, told, strict=True)]

    y = np.clip(to(np.clip(start, LOW, HIGH)), lo, hi)
    ((v, g),) = yield from at(y)
    h = np.eye(5) / max(1.0, np.abs(g).max())
    for k in range(1, steps + 1):
        free = ~hold & ~((y <= lo + 1e-12) & (g > 0)) & ~((y >= hi - 1e-12) & (g < 0))
        if not free.any() or np.abs(g[free]).max() <= 1e-7 * max(1.0, abs(v)):
            return np.clip(back(y), LOW, HIGH), v, k, True
        d = np.zeros(5)
        if curvature is not None:
            values, vectors = np.linalg.eigh(curvature(np.clip(back(y), LOW, HIGH))[np.ix_(free, free)])
            values = np.maximum(np.abs(values), 1e-7 * np.abs(values).max() + 1e-300)
            d[free] = -vectors @ (vectors.T @ g[free] / values)
        else:
            d[free] = -h[np.ix_(free, free)] @ g[free]
        if d @ g >= 0:
            d = np.where(free, -g, 0) / max(1.0, np.abs(g).max())
            h = np.eye(5) / max(1.0, np.abs(g).max())
        d *= min(1.0, 4 / np.abs(d).max())
        t, done = 1.0, False
        while t > 1e-12 and not done:
            tries = [np.clip(y + t / 2**i * d, lo, hi) for i in range(fan)]
            for new, (nv, ng) in zip(tries, (yield from at(*tries)), strict=True):
                if np.isfinite(nv) and nv <= v + 1e-4 * (g @ (new - y)):
                    done = True
                    break
            t /= 2**fan
        if not done:
            return np.clip(back(y), LOW, HIGH), v, k, np.abs(g[free]).max() <= 1e-4 * max(1.0, abs(v))
        s, q = new - y, ng - g
        if s @ q > 1e-12 * np.linalg.norm(s) * np.linalg.norm(q):
            r = 1 / (s @ q)
            i = np.eye(5) - r * np.outer(s, q)
            h = i @ h @ i.T + r * np.outer(s, s)
        small = abs(v - nv) <= still * max(1.0, abs(v))
        y, v, g = new, nv, ng
        if small:
            return np.clip(back(y), LOW, HIGH), v, k, True
    return np.clip(back(y), LOW, HIGH), v, steps, False


def minimize(f: Callable, start: np.ndarray, fixed: np.ndarray | None = None, steps: int = 500) -> tuple[np.ndarray, float, int, bool]:
    """A search over a function of this process: (theta, value, iterations, converged)."""
    running = search(start, fixed, steps)
    try:
        asked = next(running)
        while True:
            asked = running.send([f(t) for t in asked])
    except StopIteration as end:
        return end.value


def minimize_together(rows: DataFrame, searches: list[Search]) -> list[tuple[np.ndarray, float, int, bool]]:
    """Searches over the points (a, expected, weight) of a table, side by side: each round is one aggregate for all that still run."""
    ends: list = [None] * len(searches)
    asked = {k: next(s) for k, s in enumerate(searches)}
    while asked:
        thetas = [t for k in asked for t in asked[k]]
        told = {r.k: r for r in derivatives(rows, thetas, "weight").collect()}  # a row a theta
        nothing = (0.0, np.zeros(5))
        value = [(-told[i].log_likelihood, -np.array([told[i][f"by_{n}"] for n in NAMES])) if i in told else nothing for i in range(len(thetas))]
        at = 0
        for k in list(asked):
            own, at = value[at : at + len(asked[k])], at + len(asked[k])
            try:
                asked[k] = searches[k].send(own)
            except StopIteration as end:
                ends[k] = end.value
                del asked[k]
    return ends


def curvature(f: Callable, theta: np.ndarray, step: float = 1e-4) -> np.ndarray:
    """Second derivatives of ``f`` in the search's coordinates, by differences of its gradient."""

    def slope(y):
        x = np.clip(_back(y), LOW, HIGH)
        return f(x)[1] * np.append(x[:4], x[4] * (1 - x[4]))

    y = _to(np.clip(theta, LOW, HIGH))
    h = np.array([(slope(y + d) - slope(y - d)) / (2 * step) for d in np.eye(5) * step])
    return (h + h.T) / 2


def _prior(found: list, allow_boundary: bool, n_pairs: int, n_rows: int) -> Prior:
    """The best of the searches that converged. None raises, and so does an optimum on a bound unless allowed."""
    good = [x for x in found if x[3]]
    if not good:
        raise EstimatorConvergenceError("no start of the gamma mixture converged")
    theta, value, steps, _ = min(good, key=lambda x: x[1])
    bound = tuple(k for k, x, a, b in zip(NAMES, theta, LOW, HIGH, strict=True) if x <= a * (1 + 1e-6) or x >= b * (1 - 1e-6))
    if bound and not allow_boundary:
        raise EstimatorConvergenceError(f"the fit ended on a bound in {', '.join(bound)}; allow_boundary accepts it as provisional")
    return Prior(*map(float, theta), nll=value, iterations=steps, n_pairs=n_pairs, n_fitted_rows=n_rows, on_boundary=bound)


def fit_points(n: np.ndarray, e: np.ndarray, w: np.ndarray, allow_boundary: bool = False) -> Prior:
    """The best of the fixed starts over points of this process."""
    same = np.unique(n, return_inverse=True)
    return _prior([minimize(lambda t: nll(t, n, e, w, same), np.array(s)) for s in STARTS], allow_boundary, int(w.sum()), len(n))


def points(table: DataFrame, squash_from: int = SQUASH_FROM) -> DataFrame:
    """The weighted points (a, expected, weight) of a table, in the shared folder; squashed above ``squash_from`` pairs."""
    if table.count() > squash_from:
        return written(squash(table), "points")
    return written(table.groupBy(F.col("a").cast("double").alias("a"), "expected").agg(F.count("*").cast("double").alias("weight")), "points")


#: A search over a table: a round is a job, so steps of 1 to 1/32 are tried in one.
_FAR = {"fan": 6, "still": 1e-9}


def coarse(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points summed up in cells of about a tenth of their size: as many as octaves allow, however many points there are."""
    cell = lambda x: F.round(F.log2(x) * OCTAVE)
    mean = lambda x: (F.sum(F.col(x) * F.col("weight")) / F.sum("weight")).alias(x)
    pdf = rows.groupBy(cell("a").alias("i"), cell("expected").alias("j")).agg(mean("a"), mean("expected"), F.sum("weight").alias("weight")).toPandas()
    return tuple(pdf[c].to_numpy(float) for c in ("a", "expected", "weight"))


def fit(table: DataFrame, allow_boundary: bool = False, squash_from: int = SQUASH_FROM) -> Prior:
    """The best optimum over all points of the table, found from those of its coarse grid.

    Every start's optimum on the grid whose likelihood is within 1e-4 of the best one's is searched
    on, once if several agree; where the grid gives none the fixed starts are.
    """
    rows = points(table, squash_from)
    n, e, w = coarse(rows)
    same = np.unique(n, return_inverse=True)
    local = lambda t: nll(t, n, e, w, same)
    near = sorted((x for x in (minimize(local, np.array(s)) for s in STARTS) if x[3]), key=lambda x: x[1])
    starts: list[np.ndarray] = []
    for theta, value, _, _ in near:
        if value <= near[0][1] + 1e-4 * abs(near[0][1]) and all(np.abs(_to(theta) - _to(t)).max() > 0.01 for t in starts):
            starts.append(theta)
    searches = [search(t, curvature=lambda x: curvature(local, x), **_FAR) for t in starts] or [search(np.array(s), **_FAR) for s in STARTS]
    size = rows.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    return _prior(minimize_together(rows, searches), allow_boundary, round(size[1]), size[0])


def profile(n: np.ndarray, e: np.ndarray, w: np.ndarray, name: str, grid: list[float], start: np.ndarray) -> list[dict]:
    """The best likelihood with one parameter fixed at each grid point, swept forward and backward with warm starts; failed points are left out."""
    k, hold = NAMES.index(name), np.arange(5) == NAMES.index(name)
    same, out = np.unique(n, return_inverse=True), []
    for direction, order in (("forward", grid), ("backward", grid[::-1])):
        theta = start.copy()
        for value in order:
            theta[k] = value
            best, v, steps, ok = minimize(lambda t: nll(t, n, e, w, same), theta, hold)
            if ok:
                theta = best.copy()
                out.append({"direction": direction, "value": value, "nll": v, "iterations": steps, "theta": best.tolist()})
    return out


def profile_of(rows: DataFrame, name: str, grid: list[float], start: np.ndarray) -> list[dict]:
    """The same over the points of a table: both sweeps of its coarse grid give a start at each grid point, and all are searched on side by side."""
    n, e, w = coarse(rows)
    same, hold = np.unique(n, return_inverse=True), np.arange(5) == NAMES.index(name)
    sweeps = profile(n, e, w, name, grid, start)
    local = lambda t: nll(t, n, e, w, same)
    searches = [search(np.array(r["theta"]), hold, curvature=lambda x: curvature(local, x), **_FAR) for r in sweeps]
    ends = minimize_together(rows, searches)
    return [r | {"nll": v, "iterations": r["iterations"] + steps, "theta": theta.tolist()} for r, (theta, v, steps, ok) in zip(sweeps, ends, strict=True) if ok]


def qn(prior: Prior) -> Column:
    """Posterior weight of the first component."""
    a, e = F.col("a").cast("double"), F.col("expected")

    def log_nb(shape: float, rate: float) -> Column:
        s, r = F.lit(shape), F.lit(rate)
        return lgamma(a + s) - lgamma(s) + s * (F.log(r) - F.log(r + e)) + a * (F.log(e) - F.log(r + e))

    gap = F.lit(float(np.log1p(-prior.p) - np.log(prior.p))) + log_nb(prior.alpha2, prior.beta2) - log_nb(prior.alpha1, prior.beta1)
    return 1 / (1 + F.exp(F.greatest(F.least(gap, F.lit(700.0)), F.lit(-700.0))))


def ebgm(prior: Prior, q: Column) -> Column:
    a, e = F.col("a").cast("double"), F.col("expected")
    one = lambda shape, rate: digamma(a + F.lit(shape)) - F.log(e + F.lit(rate))
    return F.exp(q * one(prior.alpha1, prior.beta1) + (1 - q) * one(prior.alpha2, prior.beta2))


def percentile(prior: Prior, q: np.ndarray, n: np.ndarray, e: np.ndarray, at: float = 0.05) -> np.ndarray:
    """A percentile of the posterior gamma mixture: the bracket doubles, then halves."""
    cdf = lambda x, i: q[i] * gammainc(prior.alpha1 + n[i], x * (prior.beta1 + e[i])) + (1 - q[i]) * gammainc(prior.alpha2 + n[i], x * (prior.beta2 + e[i]))
    low, high, live = np.zeros(len(n)), np.ones(len(n)), np.arange(len(n))
    for _ in range(64):
        live = live[cdf(high[live], live) < at]
        if not len(live):
            break
        low[live] = high[live]
        high[live] *= 2
        if high.max() > CEILING:
            raise EstimatorConvergenceError("a posterior percentile lies above every bracket")
    every = np.arange(len(n))
    for _ in range(BISECTIONS):
        mid = (low + high) / 2
        below = cdf(mid, every) < at
        low, high = np.where(below, mid, low), np.where(below, high, mid)
        if ((high - low) <= 1e-15 * high).all():
            break
    return (low + high) / 2


def score(table: DataFrame, prior: Prior, at: float = 0.05) -> DataFrame:
    """The table with ``qn``, ``ebgm`` and ``ebgm05``. Equal (a, expected) pairs of a batch are solved once."""

    @F.pandas_udf("double")
    def lower(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, a, e in parts:
            pair, which = np.unique(np.stack([a.to_numpy(float), e.to_numpy(float)]), axis=1, return_inverse=True)
            first = np.zeros(pair.shape[1], int)
            first[which.ravel()] = np.arange(len(a))
            yield pd.Series(percentile(prior, q.to_numpy(float)[first], pair[0], pair[1], at)[which.ravel()])

    out = table.withColumn("qn", qn(prior))
    return out.withColumn("ebgm", ebgm(prior, F.col("qn"))).withColumn("ebgm05", lower("qn", F.col("a").cast("double"), "expected"))


def flags(prior: Prior, adjudicated: bool = False) -> dict[str, Column]:
    """``flag_mgps``, and the conjunction of all four: null while the prior is provisional and nobody has ruled on it."""
    four = F.col("flag_ror_prr_bcpnn") & (F.col("ebgm05") > 2)
    return {"flag_mgps": F.col("ebgm05") > 2, "flag_all_four": F.lit(None).cast("boolean") if prior.provisional and not adjudicated else four}
