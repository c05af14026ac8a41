"""Estimators against golden tables, MGPS against its own distribution, invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medsentry.errors import EstimatorConvergenceError
from medsentry.functions import special
from medsentry.operators import contingency, estimators, mgps
from medsentry.plans import signals

# cells, then ror, prr, chi2, ic, ic025, ic025_exact, ic_observed_expected
GOLDEN = [
    ((25, 1975, 1000, 97000), (1.227848, 1.225, 0.804664, 0.245335, -0.336457, -0.324810, 0.286304)),
    ((3, 97, 500, 99400), (6.148454, 5.994, 7.976506, 1.227157, -0.341965, -0.310554, 2.576332)),
    ((100, 100, 100, 99700), (997.0, 499.0, 24650.528512, 6.168692, 5.761634, 5.769783, 7.965784)),
    ((5, 995, 2000, 97000), (0.243719, 0.2475, 10.883598, -1.935272, -3.168895, -3.144201, -2.003602)),
    ((5000, 50000, 100000, 9845000), (9.845, 9.040909, 34408.433564, 3.111664, 3.068154, 3.069025, 3.114035)),
    ((12, 18, 30, 40), (0.888889, 0.933333, 0.001955, -0.110880, -1.055801, -1.036886, -0.070389)),
    ((4, 6, 20, 999970), (33332.333333, 19999.8, 51036.402132, 2.268086, 0.543362, 0.577887, 14.024678)),
]


def table(spark, cells):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, a bigint, b bigint, c bigint, d bigint")


def test_golden(spark):
    for r in estimators.score(table(spark, [c for c, _ in GOLDEN])).collect():
        got = (r.ror, r.prr, r.chi2, r.ic, r.ic025, r.ic025_exact, r.ic_observed_expected)
        assert got == pytest.approx(GOLDEN[r.i][1], abs=2e-6, rel=1e-6)
        assert r.ror_lower <= r.ror <= r.ror_upper and r.prr_lower <= r.prr <= r.prr_upper


def test_degenerate_tables(spark):
    cells = [(0, 0, 0, 0), (0, 0, 500, 99500), (0, 500, 0, 99500), (3 * 10**9,) * 4, (0, 10, 20, 1000)]
    rows = {r.i: r for r in estimators.score(table(spark, cells)).collect()}
    assert rows[0].ror == 1.0 and rows[0].corrected
    assert rows[1].chi2 == rows[2].chi2 == 0.0
    assert rows[3].ror == pytest.approx(1.0) and np.isfinite(rows[3].ic)
    assert rows[4].corrected and rows[4].ic_observed_expected == float("-inf") and np.isfinite(rows[4].ic)


def test_alpha():
    assert estimators.z_value(0.05) == pytest.approx(1.959963984540054)
    for bad in (0, 1, -1):
        with pytest.raises(ValueError):
            estimators.z_value(bad)


def test_special_functions(spark):
    x = [1e-6, 0.5, 1.0, 3.3, 40.0, 1e6]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select(special.lgamma(F.col("x")).alias("l"), special.digamma(F.col("x")).alias("d"), special.trigamma(F.col("x")).alias("t")).collect()
    import math

    assert [r.l for r in rows] == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    assert rows[2].d == pytest.approx(-0.5772156649015329, abs=1e-14) and rows[2].t == pytest.approx(np.pi**2 / 6, abs=1e-13)


def simulated(n=20000, theta=(0.5, 0.4, 2.2, 2.0, 0.3)):
    rng = np.random.default_rng(0)
    e = rng.gamma(1, 2, n) + 0.01
    first = rng.random(n) < theta[4]
    rate = np.where(first, rng.gamma(theta[0], 1 / theta[1], n), rng.gamma(theta[2], 1 / theta[3], n))
    k = rng.poisson(rate * e)
    return k[k > 0].astype(float), e[k > 0], np.array(theta)


def test_fit_recovers_the_likelihood():
    n, e, theta = simulated()
    w = np.ones(len(n))
    p = mgps.fit_points(n, e, w)
    assert p.nll <= mgps.nll(theta, n, e, w)[0] and not p.on_boundary


def test_gradient():
    n, e, theta = simulated(500)
    w = np.ones(len(n))
    _, g = mgps.nll(theta, n, e, w)
    for i in range(5):
        step = np.eye(5)[i] * 1e-6
        assert g[i] == pytest.approx((mgps.nll(theta + step, n, e, w)[0] - mgps.nll(theta - step, n, e, w)[0]) / 2e-6, rel=1e-4, abs=1e-4)


def test_boundary_raises():
    # Counts that all equal their expectation have less spread than any gamma mixture within the bounds.
    n, e, w = np.array([2.0]), np.array([2.0]), np.array([3000.0])
    with pytest.raises(EstimatorConvergenceError):
        mgps.fit_points(n, e, w)
    assert mgps.fit_points(n, e, w, allow_boundary=True).on_boundary


@settings(max_examples=30, deadline=None)
@given(st.floats(0.05, 5), st.floats(0.05, 5), st.floats(0.05, 0.95), st.integers(1, 500), st.floats(0.01, 300))
def test_percentile_is_a_percentile(alpha, beta, q, n, e):
    prior = mgps.Prior(alpha, beta, 2 * alpha, 3 * beta, 0.3)
    one = lambda v: np.array([v], float)
    x = mgps.percentile(prior, one(q), one(n), one(e))
    cdf = q * special.gammainc(one(alpha + n), x * (beta + e)) + (1 - q) * special.gammainc(one(2 * alpha + n), x * (3 * beta + e))
    assert cdf[0] == pytest.approx(0.05, abs=1e-9)


def test_squash_keeps_weight(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), float(x)) for a, x in zip(rng.integers(1, 4, 3000), rng.gamma(1, 2, 3000), strict=True)]
    out = mgps.squash(spark.createDataFrame(rows, "a bigint, expected double"), 20, 3, 5).toPandas()
    assert out.weight.sum() == 3000 and len(out) < 400
    mean = (out.expected * out.weight).groupby(out.a).sum()
    for a in (1, 2, 3):
        assert mean[a] == pytest.approx(sum(x for k, x in rows if k == a))


def test_flags_and_withholding(spark):
    cells = [(400, 4000, 2000, 9993600), (50, 500, 2000, 9997450), (1, 10, 2000, 9997989), (2, 20, 2000, 9997978)]
    t = table(spark, cells).withColumn("expected", (F.col("a") + F.col("b")).cast("double") * (F.col("a") + F.col("c")) / (F.col("a") + F.col("b") + F.col("c") + F.col("d")))
    prior = mgps.Prior(2.94073934, 0.38537165, 2.15410622, 2.03677734, 0.0720271218954894)
    own = signals.flag_counts(signals.panel(t, prior)).first()
    assert own.insufficient == 2 and own.prr_including_insufficient > 2 >= own.prr and own.ror == own.ror_including_insufficient
    held = mgps.Prior(*prior.theta, on_boundary=("alpha1",))
    row = signals.flag_counts(signals.panel(t, held)).first()
    assert row.all_four is None and row.all_four_including_insufficient is None
    assert signals.flag_counts(signals.panel(t, held, adjudicated=True)).first().all_four == own.all_four


def by_loops(theta, n, e):
    """Log density of a count under each truncated component, pair by pair."""
    import math

    def log_nb(shape, rate):
        f = math.lgamma(n + shape) - math.lgamma(shape) - math.lgamma(n + 1) + shape * math.log(rate / (rate + e)) + n * math.log(e / (rate + e))
        return f, math.log(1 - (rate / (rate + e)) ** shape)

    return log_nb(*theta[0:2]), log_nb(*theta[2:4])


GRID = [(1, 0.1), (1, 3.0), (2, 0.4), (3, 0.02), (5, 5.0), (17, 2.5), (40, 61.0), (300, 20.0), (2500, 900.0)]
THETA = (2.94073934, 0.38537165, 2.15410622, 2.03677734, 0.0720271218954894)


def test_likelihood_by_loops():
    import math

    n, e = (np.array(x, float) for x in zip(*GRID, strict=True))
    w = np.arange(1.0, len(n) + 1)
    want = 0.0
    for k, x, m in zip(n, e, w, strict=True):
        (f1, s1), (f2, s2) = by_loops(THETA, k, x)
        want -= m * math.log(THETA[4] * math.exp(f1 - s1) + (1 - THETA[4]) * math.exp(f2 - s2))
    assert mgps.nll(np.array(THETA), n, e, w)[0] == pytest.approx(want, rel=1e-10)


def test_scores_by_integration(spark):
    """qn, EBGM and EBGM05 of single pairs against sums over a fine grid of the posterior density."""
    import math

    p = mgps.Prior(*THETA)
    rows = mgps.score(spark.createDataFrame(GRID, "a bigint, expected double"), p).collect()
    for r, (n, e) in zip(rows, GRID, strict=True):
        (f1, _), (f2, _) = by_loops(THETA, n, e)
        q = 1 / (1 + (1 - p.p) / p.p * math.exp(f2 - f1))
        assert r.qn == pytest.approx(q, rel=1e-8)
        x = np.exp(np.linspace(-14, 8, 400_001))
        dense = sum(m * np.exp((s + n) * math.log(b + e) + (s + n) * np.log(x) - (b + e) * x - math.lgamma(s + n)) for m, s, b in ((q, p.alpha1, p.beta1), (1 - q, p.alpha2, p.beta2)))  # in log x
        mass = (dense[1:] + dense[:-1]) / 2 * np.diff(np.log(x))
        assert mass.sum() == pytest.approx(1, abs=1e-6)
        assert math.log(r.ebgm) == pytest.approx(float((mass * (np.log(x[1:]) + np.log(x[:-1])) / 2).sum()), abs=1e-6)
        assert r.ebgm05 == pytest.approx(float(np.interp(0.05, np.cumsum(mass), x[1:])), rel=1e-3)


def test_profile_and_squash_of_equal_pairs(spark):
    n, e, _ = simulated(1500)
    start = np.array([0.5, 0.4, 2.2, 2.0, 0.3])
    rows = mgps.profile(n, e, np.ones(len(n)), "alpha1", [0.3, 0.5], start)
    assert {r["direction"] for r in rows} == {"forward", "backward"} and all(r["theta"][0] == pytest.approx(r["value"]) for r in rows)
    same = spark.range(5000).selectExpr("1 as a", "if(id < 3000, 0.5, id / 1000) as expected")
    out = mgps.squash(same, 20, 3, 5).toPandas()
    # Ranks 1 to 3000 have one expected count: 150 bins of it; 1997 more in bins of 20, and 3 single ones.
    assert out.weight.sum() == 5000 and (out.expected == 0.5).sum() == 150 and sorted(out.weight)[:3] == [1, 1, 1] and len(out) == 150 + 100 + 3


def test_negative_cells_raise(spark):
    rows = spark.createDataFrame([(3, 4, 5, 90), (3, 4, -1, 90)], "a bigint, b bigint, c bigint, d bigint")
    assert estimators.score(rows.filter("c > 0")).count() == 1
    with pytest.raises(Exception, match="negative cell"):
        estimators.score(rows).collect()
    assert tuple(contingency.violations(rows.withColumn("n_cases", F.lit(102))).first()) == (2, 1, 1)


def test_log_likelihood_in_spark(spark):
    rng = np.random.default_rng(3)
    n, e, w = rng.integers(1, 40, 60), rng.uniform(0.01, 30, 60), rng.integers(1, 9, 60)
    prior = mgps.Prior(0.2, 0.06, 1.4, 1.8, 0.1)
    rows = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(n, e, w, strict=True)], "a bigint, expected double, weight double")
    got = mgps.log_likelihood(rows, prior, "weight").first()
    want = -mgps.nll(prior.theta, n.astype(float), e, w.astype(float))[0]
    assert got.pairs == w.sum() and abs(got.log_likelihood - want) < 1e-6 * abs(want)


# --- fits and profiles over tables ---


def test_fit_of_a_table_is_the_fit_of_its_points(spark):
    n, e, _ = simulated(8000)
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(n, e, strict=True)], "a bigint, expected double")
    every, one = mgps.fit_points(n, e, np.ones(len(n))), mgps.fit(rows)
    assert one.nll == pytest.approx(every.nll, rel=1e-9) and one.theta == pytest.approx(every.theta, rel=1e-2)
    assert one.n_pairs == one.n_fitted_rows == len(n) and not one.on_boundary
    squashed = mgps.fit(rows, squash_from=100)
    assert squashed.n_pairs == len(n)


def test_derivatives_in_spark(spark):
    rng = np.random.default_rng(4)
    n, e, w = rng.integers(1, 60, 90), rng.uniform(0.01, 40, 90), rng.integers(1, 9, 90)
    rows = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(n, e, w, strict=True)], "a bigint, expected double, weight double").repartition(4)
    thetas = [np.array(t) for t in ((0.2, 0.06, 1.4, 1.8, 0.1), (1e-6, 1e-6, 50.0, 1e4, 1 - 1e-6), (3.0, 2.0, 0.5, 0.5, 0.5))]
    got = {r.k: r for r in mgps.derivatives(rows, thetas, "weight").collect()}
    for k, t in enumerate(thetas):
        v, g = mgps.nll(t, n.astype(float), e, w.astype(float))
        assert -got[k].log_likelihood == pytest.approx(v, rel=1e-9)
        assert [-got[k][f"by_{x}"] for x in mgps.NAMES] == pytest.approx(g.tolist(), rel=1e-6, abs=1e-6)
    assert mgps.derivatives(rows.limit(0), thetas).collect() == []


def test_boundary_of_a_table(spark):
    rows = spark.createDataFrame([(2, 2.0)] * 3000, "a bigint, expected double")
    with pytest.raises(EstimatorConvergenceError):
        mgps.fit(rows)
    assert mgps.fit(rows, allow_boundary=True).on_boundary


def test_profile_of_a_table(spark):
    n, e, _ = simulated(1500)
    w, grid, start = np.ones(len(n)), [0.2, 0.5, 1.0], np.array([0.5, 0.4, 2.2, 2.0, 0.3])
    rows = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(n, e, strict=True)], "a double, expected double, weight double")
    want = {(r["direction"], r["value"]): r["nll"] for r in mgps.profile(n, e, w, "alpha1", grid, start)}
    got = {(r["direction"], r["value"]): r["nll"] for r in mgps.profile_of(rows, "alpha1", grid, start)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


# --- order statistics ---


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 1.5, -2.0]), st.floats(-1e6, 1e6)), max_size=60), st.floats(0, 1))
def test_order_statistics(spark, values, share):
    from medsentry.operators.ranks import order_statistics

    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = order_statistics(df, "x", {"low": 0.0, "some": share, "high": 1.0}).collect()
    assert len(got) == 1
    known = [v for v in values if v is not None]
    if not known:
        assert tuple(got[0]) == (None, None, None)
    else:
        assert tuple(got[0]) == pytest.approx(np.quantile(known, [0, share, 1]).tolist(), rel=1e-9, abs=1e-6)


def test_order_statistics_have_no_percentile(spark):
    from medsentry.operators.ranks import order_statistics

    df = spark.range(30_000).selectExpr("cast(if(id % 3 = 0, 7, id) as double) as x")
    out = order_statistics(df, "x", {"p50": 0.5, "p99": 0.99})
    assert out.first().asDict() == pytest.approx(dict(zip(("p50", "p99"), np.quantile([7.0 if i % 3 == 0 else i for i in range(30_000)], [0.5, 0.99]).tolist(), strict=True)))
    assert "percentile" not in out._jdf.queryExecution().toString()
