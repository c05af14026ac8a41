"""The engine's operators as named queries over the driver's tables, each with the same query in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import drugnames, special, text
from ..operators import chains, contingency, dedup, estimators, mgps, parse, rxnorm
from ..sources import files, links, standards, store
from ..sources.quarter import Quarter
from ..sources.schema import source_fields
from ..storage import shared_dir, written
from ..streaming import cases as stream
from . import accessors, analogue, quality, signals
from .ingest import duplicates as duplicate_pass
from .ingest import figures_from_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RAW = contingency.Spec("raw_string")
#: A fixed prior, so that scores can be held against SQL.
PRIOR = mgps.Prior(0.2, 0.06, 1.4, 1.8, 0.1)


def query(sql: str | None = None):
    """Register a function of a Corpus under its name; ``sql`` follows the analogue tables."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(analogue.Corpus(spark, sf_dir))
        if sql:
            head = "WITH RECURSIVE" if sql.startswith("RECURSIVE") else "WITH"
            ORACLE_SQL[f.__name__] = f"{head} {analogue.SQL}{sql.removeprefix('RECURSIVE')}"
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the last digits of sums depend on their order."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- contingency and estimators ---

_DRUG_KEY = {"name": "upper(trim(drugname_raw))", "part": "concat('D', part)"}


def _pairs_sql(key: str, roles: str = "'PS', 'SS'") -> str:
    return f""",
people AS (SELECT primaryid FROM cases ANTI JOIN superseded USING (primaryid)),
cd AS (SELECT DISTINCT primaryid, {_DRUG_KEY[key]} AS drug FROM drugs SEMI JOIN people USING (primaryid) WHERE role_cod IN ({roles})),
cr AS (SELECT DISTINCT primaryid, pt FROM reactions SEMI JOIN people USING (primaryid)),
n AS (SELECT count(*) AS n FROM people),
dm AS (SELECT drug, count(*) AS nd FROM cd GROUP BY drug), pm AS (SELECT pt, count(*) AS np FROM cr GROUP BY pt),
cells AS (SELECT drug, pt, a, nd - a AS b, np - a AS c, n - nd - np + a AS d, n AS n_cases, CAST(nd AS DOUBLE) * np / n AS expected
    FROM (SELECT drug, pt, count(*) AS a FROM cd JOIN cr USING (primaryid) GROUP BY drug, pt) JOIN dm USING (drug) JOIN pm USING (pt), n)"""


def _pairs(c: analogue.Corpus, key: str = "name", spec: contingency.Spec = RAW) -> DataFrame:
    drugs = c.drugs()
    if key == "part":  # many sparse pairs, as the corpus has
        drugs = drugs.withColumn("drugname_raw", F.concat(F.lit("D"), F.col("part").cast("string")))
    return contingency.build(c.publications(), drugs, c.reactions(), c.duplicates(), spec)


_ESTIMATES = f""",
h AS (SELECT *, a = 0 OR b = 0 OR c = 0 OR d = 0 AS corrected, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5 ELSE 0.0 END AS h, CAST(a AS DOUBLE) AS x, CAST(a + b AS DOUBLE) AS r, CAST(a + c AS DOUBLE) AS k, CAST(a + b + c + d AS DOUBLE) AS t FROM cells),
l AS (SELECT *, ln(a + h) + ln(d + h) - ln(b + h) - ln(c + h) AS lr, sqrt(1 / (a + h) + 1 / (b + h) + 1 / (c + h) + 1 / (d + h)) AS sr,
    ln(a + h) - ln(a + b + 2 * h) - ln(c + h) + ln(c + d + 2 * h) AS lp, sqrt(greatest(1 / (a + h) - 1 / (a + b + 2 * h) + 1 / (c + h) - 1 / (c + d + 2 * h), 0)) AS sp,
    CASE WHEN r * k * (t - r) * (t - k) = 0 THEN 0.0 ELSE power(greatest(abs(x * d - CAST(b AS DOUBLE) * c) / t - 0.5, 0), 2) * (t / (r * k) + t / (r * (t - k)) + t / ((t - r) * k) + t / ((t - r) * (t - k))) END AS chi2,
    (t + 2) * (t + 2) / ((r + 1) * (k + 1)) AS gamma FROM h),
e AS (SELECT *, exp(lr) AS ror, exp(lr - {estimators.Z!r} * sr) AS ror_lower, exp(lr + {estimators.Z!r} * sr) AS ror_upper, exp(lp) AS prr, exp(lp - {estimators.Z!r} * sp) AS prr_lower, exp(lp + {estimators.Z!r} * sp) AS prr_upper,
    ({special.digamma_sql("x + 1")} - {special.digamma_sql("t + gamma")} - ({special.digamma_sql("r + 1")} - {special.digamma_sql("t + 2")}) - ({special.digamma_sql("k + 1")} - {special.digamma_sql("t + 2")})) / ln(2) AS ic,
    sqrt({special.trigamma_sql("x + 1")} - {special.trigamma_sql("t + gamma")} + {special.trigamma_sql("r + 1")} - {special.trigamma_sql("t + 2")} + {special.trigamma_sql("k + 1")} - {special.trigamma_sql("t + 2")}) / ln(2) AS sd FROM l),
scored AS (SELECT *, ic - 2 * sd AS ic025, ic - {estimators.Z!r} * sd AS ic025_exact, ln(t * x / (r * k)) / ln(2) AS ic_observed_expected, a < 3 AS insufficient,
    a >= 3 AND ror_lower > 1 AS flag_ror, chi2 >= 4 AND prr_lower > 1 AS flag_prr, ic - 2 * sd > 0 AS flag_bcpnn,
    a >= 3 AND ror_lower > 1 AND chi2 >= 4 AND prr_lower > 1 AND ic - 2 * sd > 0 AS flag_ror_prr_bcpnn FROM e)"""


@query(_pairs_sql("name") + "SELECT drug, pt, a, b, c, d, n_cases, round(expected, 6) AS expected FROM cells")
def contingency_pairs(c):
    return rounded(_pairs(c))


@query(_pairs_sql("part", "'PS'") + "SELECT drug, pt, a, b, c, d, n_cases, round(expected, 6) AS expected FROM cells")
def contingency_primary_suspect(c):
    return rounded(_pairs(c, "part", contingency.Spec("raw_string", "ps")))


@query(_pairs_sql("part") + "SELECT drug, pt, a FROM cells ORDER BY a DESC, drug, pt")
def contingency_ordered(c):
    return contingency.ordered(_pairs(c, "part").select("drug", "pt", "a"))


@query(_pairs_sql("part") + "SELECT count(*) AS pairs, 0::BIGINT AS negative, count(*) FILTER (WHERE a + b + c + d <> n_cases) AS unequal FROM cells")
def contingency_invariants(c):
    return contingency.violations(_pairs(c, "part"))


@query(_pairs_sql("name") + _ESTIMATES + "SELECT drug, pt, corrected, insufficient, flag_ror, flag_prr, " + ", ".join(f"round({x}, 6) AS {x}" for x in "ror ror_lower ror_upper prr prr_lower prr_upper chi2".split()) + " FROM scored")
def estimators_ror_prr(c):
    return rounded(estimators.score(_pairs(c)).select("drug", "pt", "corrected", "insufficient", "flag_ror", "flag_prr", "ror", "ror_lower", "ror_upper", "prr", "prr_lower", "prr_upper", "chi2"))


@query(_pairs_sql("name") + _ESTIMATES + "SELECT drug, pt, flag_bcpnn, flag_ror_prr_bcpnn, " + ", ".join(f"round({x}, 6) AS {x}" for x in "ic ic025 ic025_exact ic_observed_expected".split()) + " FROM scored")
def estimators_bcpnn(c):
    return rounded(estimators.score(_pairs(c)).select("drug", "pt", "flag_bcpnn", "flag_ror_prr_bcpnn", "ic", "ic025", "ic025_exact", "ic_observed_expected"))


def _nb(shape: float, rate: float) -> str:
    return f"lgamma(a + {shape!r}) - lgamma({shape!r}) + {shape!r} * (ln({rate!r}) - ln({rate!r} + expected)) + a * (ln(expected) - ln({rate!r} + expected))"


@query(
    _pairs_sql("part")
    + f""",
w AS (SELECT *, 1 / (1 + exp(ln(1 - {PRIOR.p!r}) - ln({PRIOR.p!r}) + {_nb(PRIOR.alpha2, PRIOR.beta2)} - ({_nb(PRIOR.alpha1, PRIOR.beta1)}))) AS qn FROM cells)
SELECT drug, pt, a, round(qn, 6) AS qn, round(exp(qn * ({special.digamma_sql(f"a + {PRIOR.alpha1!r}")} - ln(expected + {PRIOR.beta1!r})) + (1 - qn) * ({special.digamma_sql(f"a + {PRIOR.alpha2!r}")} - ln(expected + {PRIOR.beta2!r}))), 6) AS ebgm FROM w"""
)
def mgps_posterior(c):
    q = mgps.qn(PRIOR)
    return rounded(_pairs(c, "part").withColumn("qn", q).withColumn("ebgm", mgps.ebgm(PRIOR, F.col("qn"))).select("drug", "pt", "a", "qn", "ebgm"))


@query()
def mgps_fit(c):
    """The fitted prior of the pair table, as one row."""
    table = _pairs(c, "part")
    p = mgps.fit(table, allow_boundary=True)
    row = [(*map(float, p.theta), p.nll, p.iterations, p.n_pairs, p.n_fitted_rows, list(p.on_boundary))]
    return c.spark.createDataFrame(row, "alpha1 double, beta1 double, alpha2 double, beta2 double, p double, nll double, iterations int, n_pairs bigint, n_fitted_rows bigint, on_boundary array<string>")


@query(
    _pairs_sql("part")
    + """,
s AS (SELECT CAST(a AS DOUBLE) AS a, expected, row_number() OVER (PARTITION BY a ORDER BY expected) AS r, count(*) OVER (PARTITION BY a) AS size FROM cells),
g AS (SELECT *, CASE WHEN size < 3 + 20 * 5 OR r > size - 3 THEN -r ELSE (r - 1) // 20 END AS g FROM s)
SELECT a, round(avg(expected), 9) AS expected, CAST(count(*) AS DOUBLE) AS weight FROM g GROUP BY a, g"""
)
def mgps_squash(c):
    return mgps.squash(_pairs(c, "part"), 20, 3, 5).select("a", F.round("expected", 9).alias("expected"), "weight")


def _truncated(shape: float, rate: float) -> str:
    return f"{_nb(shape, rate)} - lgamma(a + 1) - ln(1 - exp({shape!r} * (ln({rate!r}) - ln({rate!r} + expected))))"


@query(
    _pairs_sql("part")
    + f", l AS (SELECT ln({PRIOR.p!r}) + {_truncated(PRIOR.alpha1, PRIOR.beta1)} AS l1, ln(1 - {PRIOR.p!r}) + {_truncated(PRIOR.alpha2, PRIOR.beta2)} AS l2 FROM cells) SELECT count(*) AS pairs, round(sum(greatest(l1, l2) + ln(1 + exp(least(l1, l2) - greatest(l1, l2)))), 3) AS log_likelihood FROM l"
)
def mgps_log_likelihood(c):
    return rounded(mgps.log_likelihood(_pairs(c, "part"), PRIOR), 3)


def _slopes(i: int, shape: float, rate: float) -> str:
    """Log density and derivatives of a truncated component."""
    log_p, odds = f"(ln({rate!r}) - ln({rate!r} + expected))", f"(1 / (1 - exp({shape!r} * (ln({rate!r}) - ln({rate!r} + expected)))))"  # odds + 1
    return f"""{_truncated(shape, rate)} AS f{i}, {special.digamma_sql(f"a + {shape!r}")} - {float(special.np_digamma(shape))!r} + {log_p} * {odds} AS s{i},
    {shape!r} * expected / ({rate!r} * ({rate!r} + expected)) * {odds} - a / ({rate!r} + expected) AS r{i}"""


@query(
    _pairs_sql("part")
    + f""",
f AS (SELECT {_slopes(1, PRIOR.alpha1, PRIOR.beta1)}, {_slopes(2, PRIOR.alpha2, PRIOR.beta2)} FROM cells),
u AS (SELECT *, 1 / (1 + exp(ln(1 - {PRIOR.p!r}) + f2 - ln({PRIOR.p!r}) - f1)) AS u FROM f)
SELECT count(*) AS pairs, round(sum(u * s1), 3) AS by_alpha1, round(sum(u * r1), 3) AS by_beta1, round(sum((1 - u) * s2), 3) AS by_alpha2, round(sum((1 - u) * r2), 3) AS by_beta2, round(sum(u / {PRIOR.p!r} - (1 - u) / (1 - {PRIOR.p!r})), 3) AS by_p FROM u"""
)
def mgps_gradient(c):
    """The derivatives that a step of the fit adds up."""
    return rounded(mgps.derivatives(_pairs(c, "part"), [PRIOR.theta]).drop("k", "log_likelihood"), 3)


#: Grid points of alpha1 from its bound on, the other parameters as in PRIOR.
GRID = tuple(float(f"{1e-6 * 10 ** (i / 2):.6g}") for i in range(13))


@query(
    _pairs_sql("part")
    + ", l AS ("
    + " UNION ALL ".join(f"SELECT {x!r} AS alpha1, ln({PRIOR.p!r}) + {_truncated(x, PRIOR.beta1)} AS l1, ln(1 - {PRIOR.p!r}) + {_truncated(PRIOR.alpha2, PRIOR.beta2)} AS l2 FROM cells" for x in GRID)
    + ") SELECT alpha1, round(sum(greatest(l1, l2) + ln(1 + exp(least(l1, l2) - greatest(l1, l2)))), 3) AS log_likelihood FROM l GROUP BY alpha1"
)
def mgps_profile_grid(c):
    """The likelihood at each grid point, all in one pass over the pairs."""
    thetas = [PRIOR.theta * [0, 1, 1, 1, 1] + [x, 0, 0, 0, 0] for x in GRID]
    alpha1 = F.element_at(F.array(*map(F.lit, GRID)), F.col("k") + 1)
    return rounded(mgps.derivatives(_pairs(c, "part"), thetas).select(alpha1.alias("alpha1"), F.round("log_likelihood", 3).alias("log_likelihood")), 12)


#: A fixed prior with whole shapes: their gamma distributions are finite sums, so SQL can tell on which side of 2 the percentile lies.
WHOLE = mgps.Prior(1.0, 0.5, 2.0, 2.0, 0.1)


def _tail(shape: float, rate: float) -> str:
    """That a gamma variable of shape a + ``shape`` and rate expected + ``rate`` is below 2."""
    x = f"2 * (expected + {rate!r})"
    return f"1 - list_sum(list_transform(range(0, a + {int(shape)}), lambda k: exp(k * ln({x}) - lgamma(k + 1) - {x})))"


def _below(shape: float, rate: float) -> str:
    """The chance that a gamma variable of shape a + ``shape`` and rate expected + ``rate`` is below x."""
    x = f"(x * (expected + {rate!r}))"
    return f"(1 - list_sum(list_transform(range(0, a + {int(shape)}), lambda k: exp(k * ln({x}) - lgamma(k + 1) - {x}))))"


@query(
    "RECURSIVE"
    + _pairs_sql("part")
    + f""",
post AS (SELECT DISTINCT a, expected, 1 / (1 + exp(ln(1 - {WHOLE.p!r}) - ln({WHOLE.p!r}) + {_nb(WHOLE.alpha2, WHOLE.beta2)} - ({_nb(WHOLE.alpha1, WHOLE.beta1)}))) AS qn FROM cells),
halves AS (
    SELECT 0 AS step, a, expected, qn, 0.0::DOUBLE AS low, greatest((a + {WHOLE.alpha1!r}) / (expected + {WHOLE.beta1!r}), (a + {WHOLE.alpha2!r}) / (expected + {WHOLE.beta2!r})) AS high FROM post
    UNION ALL
    SELECT step + 1, a, expected, qn, CASE WHEN f < 0.05 THEN x ELSE low END, CASE WHEN f < 0.05 THEN high ELSE x END
    FROM (SELECT *, qn * {_below(WHOLE.alpha1, WHOLE.beta1)} + (1 - qn) * {_below(WHOLE.alpha2, WHOLE.beta2)} AS f FROM (SELECT *, (low + high) / 2 AS x FROM halves WHERE step < 60))),
solved AS (SELECT a, expected, qn, low AS x FROM halves WHERE step = 60)
SELECT drug, pt, a, round(qn, 6) AS qn, round(exp(qn * ({special.digamma_sql(f"a + {WHOLE.alpha1!r}")} - ln(expected + {WHOLE.beta1!r})) + (1 - qn) * ({special.digamma_sql(f"a + {WHOLE.alpha2!r}")} - ln(expected + {WHOLE.beta2!r}))), 6) AS ebgm, round(x, 6) AS ebgm05
FROM cells JOIN solved USING (a, expected)"""
)
def mgps_lower_bound(c):
    """EBGM05 as the fifth percentile itself, under the prior whose distribution SQL can sum up."""
    return rounded(mgps.score(_pairs(c, "part"), WHOLE).select("drug", "pt", "a", "qn", "ebgm", "ebgm05"))


_PANEL = (
    _pairs_sql("part")
    + _ESTIMATES
    + f""",
post AS (SELECT *, 1 / (1 + exp(ln(1 - {WHOLE.p!r}) - ln({WHOLE.p!r}) + {_nb(WHOLE.alpha2, WHOLE.beta2)} - ({_nb(WHOLE.alpha1, WHOLE.beta1)}))) AS qn FROM scored),
panel AS (SELECT *, flag_mgps AND flag_ror_prr_bcpnn AS flag_all_four FROM (SELECT *, qn * ({_tail(WHOLE.alpha1, WHOLE.beta1)}) + (1 - qn) * ({_tail(WHOLE.alpha2, WHOLE.beta2)}) < 0.05 AS flag_mgps FROM post))"""
)


@query(_PANEL + "SELECT drug, pt, a, flag_ror, flag_prr, flag_bcpnn, flag_mgps, flag_ror_prr_bcpnn, flag_all_four FROM panel")
def signal_flags(c):
    return signals.panel(_pairs(c, "part"), WHOLE).select("drug", "pt", "a", "flag_ror", "flag_prr", "flag_bcpnn", "flag_mgps", "flag_ror_prr_bcpnn", "flag_all_four")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE {f} AND NOT insufficient) AS {n}, count(*) FILTER (WHERE {f}) AS {n}_including_insufficient" for n, f in (("ror", "flag_ror"), ("prr", "flag_prr"), ("bcpnn", "flag_bcpnn"), ("ror_prr_bcpnn", "flag_ror_prr_bcpnn")))


@query(_PANEL + f"SELECT count(*) AS pairs, count(*) FILTER (WHERE insufficient) AS insufficient, {_COUNTS}, " + ", ".join(f"count(*) FILTER (WHERE flag_{f} AND NOT insufficient) AS {f}, count(*) FILTER (WHERE flag_{f}) AS {f}_including_insufficient" for f in ("mgps", "all_four")) + " FROM panel")
def signal_panel_counts(c):
    return signals.flag_counts(signals.panel(_pairs(c, "part"), WHOLE))


@query(_pairs_sql("part") + _ESTIMATES + f"SELECT count(*) AS pairs, count(*) FILTER (WHERE insufficient) AS insufficient, {_COUNTS} FROM scored")
def signal_flag_counts(c):
    return signals.flag_counts(estimators.score(_pairs(c, "part")), ("ror", "prr", "bcpnn", "ror_prr_bcpnn"))


@query(_pairs_sql("part") + _ESTIMATES + "SELECT round(max(g), 6) AS max_gap, round(median(g), 6) AS median_gap, round(avg(CASE WHEN g > 1 THEN 1.0 ELSE 0.0 END), 6) AS share_above_one FROM (SELECT abs(ic_observed_expected - ic) AS g FROM scored)")
def signal_ic_divergence(c):
    return rounded(signals.ic_divergence(estimators.score(_pairs(c, "part"))))


@query(_pairs_sql("part") + _ESTIMATES + "SELECT round(quantile_cont(ic, 0.5), 6) AS p50, round(quantile_cont(ic, 0.9), 6) AS p90, round(quantile_cont(ic, 0.99), 6) AS p99, round(max(ic), 6) AS max FROM scored WHERE NOT insufficient")
def signal_quantiles(c):
    return rounded(signals.quantiles(estimators.score(_pairs(c, "part")), "ic"))


# --- duplicates ---

_DEDUP = """,
ds AS (SELECT primaryid, list_sort(list(DISTINCT drugname_raw)) AS drugs FROM (SELECT primaryid, kind AS drugname_raw FROM drugs) GROUP BY 1),
rs AS (SELECT primaryid, list_sort(list(DISTINCT region)) AS reactions FROM reactions GROUP BY 1),
status AS (SELECT c.*, round(age_years) AS age_r, drugs, CASE WHEN s.primaryid IS NOT NULL THEN 'superseded' WHEN sex IS NULL OR age_years IS NULL OR country IS NULL THEN 'null_key' WHEN drugs IS NULL THEN 'empty_drug_set' ELSE 'eligible' END AS status
    FROM cases c LEFT JOIN superseded s ON c.primaryid = s.primaryid LEFT JOIN ds ON c.primaryid = ds.primaryid),
compared AS (SELECT s.*, coalesce(reactions, []) AS reactions FROM status s LEFT JOIN rs ON s.primaryid = rs.primaryid WHERE status = 'eligible' QUALIFY count(*) OVER (PARTITION BY sex, age_r, country) > 1)"""
_SIMILAR = (
    _DEDUP
    + """,
sims AS (SELECT l.primaryid AS l, r.primaryid AS r, l.fda_dt AS lf, r.fda_dt AS rf, l.quarter <> r.quarter AS cross_quarter, len(list_intersect(l.drugs, r.drugs)) AS di, len(l.drugs) + len(r.drugs) AS dn, len(list_intersect(l.reactions, r.reactions)) AS ri, len(l.reactions) + len(r.reactions) AS rn
    FROM compared l JOIN compared r ON l.sex = r.sex AND l.age_r = r.age_r AND l.country = r.country AND l.primaryid < r.primaryid AND l.caseid <> r.caseid),
pairs AS (SELECT *, di / (dn - di) AS dj, ri / (rn - ri) AS rj, (lf, l) > (rf, r) AS left_later FROM sims WHERE di > 0 AND ri > 0 AND 5 * di >= 4 * (dn - di) AND 5 * ri >= 4 * (rn - ri)),
best AS (SELECT CASE WHEN left_later THEN r ELSE l END AS primaryid, CASE WHEN left_later THEN l ELSE r END AS canonical_primaryid, CASE WHEN left_later THEN lf ELSE rf END AS f, dj, rj, cross_quarter FROM pairs
    QUALIFY row_number() OVER (PARTITION BY CASE WHEN left_later THEN r ELSE l END ORDER BY CASE WHEN left_later THEN lf ELSE rf END DESC, CASE WHEN left_later THEN l ELSE r END DESC) = 1),
flagged AS (SELECT primaryid, canonical_primaryid, 'version' AS method, 1.0 AS score, NULL AS drug_jaccard, NULL AS reaction_jaccard, FALSE AS cross_quarter FROM superseded
    UNION ALL SELECT primaryid, canonical_primaryid, 'probabilistic', least(dj, rj), dj, rj, cross_quarter FROM best ANTI JOIN superseded USING (primaryid))"""
)


def _inputs(c):
    """Cases with drug and reaction sets that are coarse enough to repeat."""
    return c.publications(), c.drugs().select("primaryid", F.col("kind").alias("drugname_raw")), c.reactions().select("primaryid", F.col("region").alias("pt"))


def _population(c) -> dedup.Population:
    cases, drugs, reactions = _inputs(c)
    return dedup.population(dedup.latest_publication(cases), drugs, reactions)


@query("SELECT * FROM superseded")
def dedup_versions(c):
    return c.duplicates()


@query("SELECT primaryid, quarter, caseid, caseversion FROM cases")
def dedup_latest_publication(c):
    return dedup.latest_publication(c.publications()).select("primaryid", "quarter", "caseid", "caseversion")


@query(", r AS (SELECT * FROM published WHERE quarter BETWEEN '1996Q1' AND '1997Q4' QUALIFY row_number() OVER (PARTITION BY primaryid ORDER BY quarter DESC) = 1) SELECT quarter, count(*) AS cases FROM r GROUP BY quarter")
def dedup_quarter_range(c):
    return dedup.latest_publication(c.publications(), "1996Q1", "1997Q4").groupBy("quarter").agg(F.count("*").alias("cases"))


@query(_DEDUP + "SELECT primaryid, status FROM status")
def dedup_status(c):
    return _population(c).status


@query(_DEDUP + "SELECT count(*) AS evaluated, count(*) FILTER (WHERE status = 'superseded') AS superseded, count(*) FILTER (WHERE status = 'null_key') AS null_key, count(*) FILTER (WHERE status = 'empty_drug_set') AS empty_drug_set, count(*) FILTER (WHERE status = 'eligible') AS eligible, (SELECT count(*) FROM compared) AS compared, count(*) FILTER (WHERE status = 'eligible') - (SELECT count(*) FROM compared) AS alone FROM status")
def dedup_accounting(c):
    return dedup.accounting(_population(c))


@query(_DEDUP + "SELECT count(*) AS blocks, max(n) AS largest_block, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS naive_pairs FROM (SELECT count(*) AS n FROM compared GROUP BY sex, age_r, country)")
def dedup_block_figures(c):
    return dedup.block_figures(_population(c))


_CLASSES = (
    _SIMILAR
    + """,
classes AS (SELECT *, min(primaryid) OVER (PARTITION BY sex, age_r, country, drugs, reactions) AS class_id FROM compared),
heads AS (SELECT * FROM classes WHERE primaryid = class_id)"""
)


@query(_CLASSES + "SELECT c.primaryid, class_id, count(p.id) AS links, count(*) FILTER (WHERE p.cross_quarter) AS cross_quarter FROM classes c LEFT JOIN (SELECT l AS id, cross_quarter FROM pairs UNION ALL SELECT r, cross_quarter FROM pairs) p ON c.primaryid = p.id GROUP BY ALL")
def dedup_similar_rows(c):
    return dedup.link_counts(dedup.similar(_population(c).compared))


@query(
    _CLASSES
    + """,
near AS (SELECT l.class_id AS l, r.class_id AS r, len(list_intersect(l.drugs, r.drugs)) AS di, len(l.drugs) + len(r.drugs) AS dn, len(list_intersect(l.reactions, r.reactions)) AS ri, len(l.reactions) + len(r.reactions) AS rn
    FROM heads l JOIN heads r ON l.sex = r.sex AND l.age_r = r.age_r AND l.country = r.country AND l.class_id < r.class_id)
SELECT l, r, round(di / (dn - di), 6) AS drugs_jaccard, round(ri / (rn - ri), 6) AS reactions_jaccard FROM near WHERE di > 0 AND ri > 0 AND 5 * di >= 4 * (dn - di) AND 5 * ri >= 4 * (rn - ri)"""
)
def dedup_similar_pairs(c):
    """Between classes of equal rows; ``dedup_similar_rows`` has each row's class."""
    linked = dedup.similar(_population(c).compared).linked.filter("class_id < other")
    return rounded(linked.withColumnsRenamed({"class_id": "l", "other": "r"}))


_CANDIDATES = (
    _CLASSES
    + """,
tokens AS (SELECT class_id, 'r' AS s, unnest(reactions) AS t FROM heads UNION ALL SELECT class_id, 'd', unnest(drugs) FROM heads),
prefixes AS (SELECT class_id, s, len(w) AS n, w[: greatest(1, len(w) - (4 * len(w) + 4) // 5 + 1)] AS p
    FROM (SELECT class_id, s, list(t ORDER BY f, t) AS w FROM tokens JOIN (SELECT s, t, count(*) AS f FROM tokens GROUP BY ALL) USING (s, t) GROUP BY class_id, s)),
keyed AS (SELECT h.class_id, sex, age_r, country, r.n AS rn, r.p AS rp, d.n AS dn, d.p AS dp FROM heads h JOIN prefixes r ON r.class_id = h.class_id AND r.s = 'r' JOIN prefixes d ON d.class_id = h.class_id AND d.s = 'd'),
met AS (SELECT l.rn AS lr, r.rn AS rr, l.dn AS ld, r.dn AS rd, l.rp AS lrp, r.rp AS rrp, l.dp AS ldp, r.dp AS rdp, list_filter(l.rp, lambda x: list_contains(r.rp, x))[1] AS t, list_filter(l.dp, lambda x: list_contains(r.dp, x))[1] AS u
    FROM keyed l JOIN keyed r ON l.sex = r.sex AND l.age_r = r.age_r AND l.country = r.country AND l.class_id < r.class_id),
candidates AS (SELECT * FROM met WHERE t IS NOT NULL AND u IS NOT NULL AND 5 * least(lr, rr) >= 4 * greatest(lr, rr) AND 5 * least(ld, rd) >= 4 * greatest(ld, rd)
    AND 9 * (1 + least(lr - list_position(lrp, t), rr - list_position(rrp, t))) >= 4 * (lr + rr) AND 9 * (1 + least(ld - list_position(ldp, u), rd - list_position(rdp, u))) >= 4 * (ld + rd))"""
)


@query(_CANDIDATES + "SELECT count(*) AS duplicate_pairs, count(*) FILTER (WHERE cross_quarter) AS cross_quarter_pairs, (SELECT count(*) FROM candidates) AS comparisons FROM pairs")
def dedup_pair_figures(c):
    """With the pairs of classes that were compared, as the two-set prefix filter leaves them."""
    return dedup.pair_figures(dedup.similar(_population(c).compared))


@query(_SIMILAR + "SELECT count(*) AS discarded FROM best SEMI JOIN superseded USING (primaryid)")
def dedup_discarded(c):
    return duplicate_pass(*_inputs(c))[1]["discarded"]


@query(_SIMILAR + "SELECT primaryid, canonical_primaryid, method, round(score, 6) AS score, round(drug_jaccard, 6) AS drug_jaccard, round(reaction_jaccard, 6) AS reaction_jaccard, cross_quarter FROM flagged")
def dedup_all(c):
    return rounded(duplicate_pass(*_inputs(c))[0])


@query(_SIMILAR + "SELECT method, count(DISTINCT primaryid) AS flagged, count(*) FILTER (WHERE cross_quarter) AS cross_quarter FROM flagged GROUP BY method")
def dedup_method_figures(c):
    return dedup.method_figures(duplicate_pass(*_inputs(c))[0])


@query(
    """,
edges AS (SELECT c_custkey AS node, (c_custkey * 7 + 3) // 10 AS dest FROM customer WHERE c_custkey % 9 <> 0 AND (c_custkey * 7 + 3) // 10 <> c_custkey),
nodes AS (SELECT node FROM edges UNION SELECT dest FROM edges),
walk AS (SELECT node, node AS d0, dest AS d1 FROM nodes LEFT JOIN edges USING (node)),
w1 AS (SELECT node, coalesce(d1, node) AS d FROM walk), w2 AS (SELECT a.node, b.d FROM w1 a JOIN w1 b ON a.d = b.node), w4 AS (SELECT a.node, b.d FROM w2 a JOIN w2 b ON a.d = b.node), w8 AS (SELECT a.node, b.d FROM w4 a JOIN w4 b ON a.d = b.node),
w16 AS (SELECT a.node, b.d FROM w8 a JOIN w8 b ON a.d = b.node), w32 AS (SELECT a.node, b.d FROM w16 a JOIN w16 b ON a.d = b.node), w64 AS (SELECT a.node, b.d FROM w32 a JOIN w32 b ON a.d = b.node)
SELECT node, d AS root, d AS component, FALSE AS on_cycle, FALSE AS closed FROM w64"""
)
def chains_roots(c):
    """Chains of pointers to ever smaller customers."""
    key = F.col("c_custkey")
    edges = c.table("customer").select(key.alias("primaryid"), F.floor((key * 7 + 3) / 10).cast("bigint").alias("canonical_primaryid")).filter("primaryid % 9 <> 0 and canonical_primaryid <> primaryid")
    return chains.resolve(edges)


@query(
    """
SELECT c_custkey AS node, CAST(NULL AS BIGINT) AS root, c_custkey // 5 * 5 AS component, c_custkey % 5 < 3 AS on_cycle, TRUE AS closed FROM customer WHERE c_custkey // 5 * 5 + 4 <= (SELECT max(c_custkey) FROM customer)"""
)
def chains_cycles(c):
    """In each five customers, three point around a cycle and two lead into it."""
    t = c.table("customer")
    key, last = F.col("c_custkey"), t.agg(F.max("c_custkey")).first()[0]
    base, at = F.floor(key / 5).cast("bigint") * 5, key % 5
    to = base + F.when(at < 2, at + 1).when(at == 2, 0).otherwise(at - 1)
    return chains.resolve(t.filter(base + 4 <= last).select(key.alias("primaryid"), to.alias("canonical_primaryid")))


@query(_SIMILAR + ", g AS (SELECT count(*) AS pointers, (SELECT count(DISTINCT canonical_primaryid) FROM flagged WHERE canonical_primaryid NOT IN (SELECT primaryid FROM flagged)) AS components FROM flagged) SELECT pointers, components, 0 AS cycles, 0 AS closed_components, TRUE AS sound FROM g")
def chains_report(c):
    edges = written(duplicate_pass(*_inputs(c))[0], "duplicates")
    return chains.report(chains.resolve(edges), edges).select("pointers", "components", F.col("cycles").cast("int").alias("cycles"), F.col("closed_components").cast("int").alias("closed_components"), "sound")


_RATES = (
    _SIMILAR
    + """,
p AS (SELECT count(*) AS evaluated, count(*) FILTER (WHERE status = 'eligible') AS eligible FROM status),
f AS (SELECT count(DISTINCT primaryid) FILTER (WHERE method = 'version') AS v, count(DISTINCT primaryid) FILTER (WHERE method = 'probabilistic') AS s FROM flagged)
SELECT stage, flagged, whole, round(flagged / whole, 6) AS rate FROM (SELECT unnest(['stage1', 'stage2', 'overall']) AS stage, unnest([v, s, v + s]) AS flagged, unnest([evaluated, eligible, evaluated]) AS whole FROM p, f)"""
)


@query(_RATES)
def quality_rates(c):
    """The rates of the quality report, each with its own denominator."""
    every, figures = duplicate_pass(*_inputs(c))
    found = {r.method: r.flagged for r in dedup.method_figures(every).collect()}  # a row a method
    out = quality.rates(figures["population"].first().asDict(), {m: found.get(m, 0) for m in (dedup.VERSION, dedup.SIMILAR)})
    return c.spark.createDataFrame([(k, out[k]["flagged"], out[k]["of"], out[k]["rate"]) for k in ("stage1", "stage2", "overall")], "stage string, flagged bigint, whole bigint, rate double")


@query(
    _SIMILAR
    + """,
p AS (SELECT count(*) AS evaluated, count(*) FILTER (WHERE status = 'superseded') AS superseded, count(*) FILTER (WHERE status = 'null_key') AS null_key, count(*) FILTER (WHERE status = 'empty_drug_set') AS empty_drug_set, count(*) FILTER (WHERE status = 'eligible') AS eligible FROM status),
f AS (SELECT count(DISTINCT primaryid) AS flagged, count(DISTINCT primaryid) FILTER (WHERE method = 'version') AS by_version, count(DISTINCT primaryid) FILTER (WHERE method = 'probabilistic') AS by_similarity, count(*) FILTER (WHERE cross_quarter) AS cross_quarter FROM flagged)
SELECT *, FALSE AS compared FROM p, f"""
)
def store_figures(c):
    """What the stored corpus and duplicate table tell of a pass; comparisons are not measured there, which isn't zero."""
    at = _folder(c, "duplicates")
    store.write_whole(duplicate_pass(*_inputs(c))[0], at)
    own = figures_from_store(*_inputs(c), c.spark.read.parquet(at))
    names = ("evaluated", "superseded", "null_key", "empty_drug_set", "eligible", "flagged", "cross_quarter")
    row = [*(own[n] for n in names), *(own["flagged_by_method"][m] for m in (dedup.VERSION, dedup.SIMILAR)), own["comparisons"] is not None]
    return c.spark.createDataFrame([row], ", ".join(f"{n} bigint" for n in (*names, "by_version", "by_similarity")) + ", compared boolean")


# --- accessors ---


@query("SELECT primaryid, pt FROM reactions WHERE primaryid = 77 ORDER BY pt")
def corpus_reactions_lookup(c):
    return accessors.reactions_of(c.reactions(), 77).select("primaryid", "pt")


@query("SELECT 'case' AS dataset, count(*) AS rows FROM published UNION ALL SELECT 'drug', count(*) FROM drugs UNION ALL SELECT 'reaction', count(*) FROM reactions")
def corpus_counts(c):
    return accessors.dataset_counts({"case": c.publications(), "drug": c.drugs(), "reaction": c.reactions()})


@query("SELECT pt, count(DISTINCT primaryid) AS cases FROM reactions GROUP BY pt ORDER BY cases DESC, pt LIMIT 10")
def corpus_top_reactions(c):
    return accessors.top_reactions(c.reactions(), 10)


@query("SELECT quarter, count(*) AS rows, count(prod_ai) AS with_prod_ai, round(100.0 * count(prod_ai) / count(*), 2) AS pct FROM drugs GROUP BY quarter")
def corpus_prod_ai_coverage(c):
    return accessors.prod_ai_coverage(c.drugs())


@query("SELECT event_dt_precision AS value, count(*) AS n FROM cases GROUP BY 1")
def corpus_date_precisions(c):
    return accessors.date_precisions(dedup.latest_publication(c.publications()))


@query("SELECT count(*) FILTER (WHERE age_years IS NULL) AS age_missing, count(*) FILTER (WHERE weight_kg IS NULL) AS weight_missing, count(*) FILTER (WHERE sex IS NULL) AS sex_missing, count(*) FILTER (WHERE country IS NULL) AS country_missing, count(*) FILTER (WHERE event_dt IS NULL) AS event_dt_missing, count(*) FILTER (WHERE country_source = 'reporter') AS country_from_reporter_fallback, count(*) AS cases FROM cases")
def corpus_field_nulls(c):
    return accessors.case_field_nulls(dedup.latest_publication(c.publications()))


@query("SELECT DISTINCT primaryid, drugname_raw, pt FROM drugs JOIN reactions USING (primaryid)")
def corpus_case_drug_reaction(c):
    return accessors.case_drug_reaction(c.drugs(), c.reactions())


@query("SELECT primaryid, drug_seq, role_cod, drugname_raw FROM drugs WHERE primaryid = 77 ORDER BY drug_seq")
def corpus_point_lookup(c):
    return accessors.drugs_of(c.drugs(), 77).select("primaryid", "drug_seq", "role_cod", "drugname_raw")


# --- scalar functions and parsing ---


def _raw_demo(c) -> DataFrame:
    """Orders written as a raw source table: text fields with every kind of defect."""
    key = F.col("o_orderkey")
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (key % len(v)).cast("int"))
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return c.table("orders").select(
        key.cast("string").alias("primaryid"),
        F.floor(key / 2).cast("bigint").cast("string").alias("caseid"),
        F.when(key % 19 != 0, (key % 2).cast("string")).otherwise("x").alias("caseversion"),
        F.when(key % 6 == 0, "").when(key % 6 == 1, F.substring(day, 1, 6)).when(key % 6 == 2, F.substring(day, 1, 4)).when(key % 6 == 3, "20130231").when(key % 6 == 4, "2013021").otherwise(day).alias("event_dt_raw"),
        *(day.alias(f"{n}_raw") for n in ("fda_dt", "init_fda_dt", "mfr_dt", "rept_dt")),
        F.when(key % 23 == 0, "old").otherwise((key % 150).cast("string")).alias("age"),
        pick("YR", "DEC", "MON", "WK", "DY", "HR", "MIN", "SEC", "").alias("age_cod"),
        (key % 700).cast("string").alias("wt"),
        pick("KG", "LBS", "GMS", "YEARS", "").alias("wt_cod"),
        pick(" f ", "M", "UNK", "").alias("sex"),
        pick(" us ", "", "COUNTRY NOT SPECIFIED", "FR", "").alias("occr_country"),
        pick("de", "", "jp").alias("reporter_country"),
        F.lit("MD").alias("occp_cod"),
    )


_UNITS = "['YR', 'DEC', 'MON', 'WK', 'DY', 'HR', 'MIN', 'SEC', '']"
_FACTORS = "[1.0, 10.0, 1.0 / 12.0, 1.0 / 52.1775, 1.0 / 365.25, 1.0 / 8766.0, 1.0 / 525960.0, 1.0 / 31557600.0, NULL]"
_RAW = f""",
raw AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m%d') AS day,
    CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN substr(day, 1, 6) WHEN 2 THEN substr(day, 1, 4) WHEN 3 THEN '20130231' WHEN 4 THEN '2013021' ELSE day END AS event_dt_raw,
    CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(k % 150 AS DOUBLE) * ({_FACTORS})[k % 9 + 1] END AS age_0,
    CAST(k % 700 AS DOUBLE) * ([1.0, 0.45359237, 0.001, NULL, NULL])[k % 5 + 1] AS wt_0,
    (['F', 'M', 'UNK', NULL])[k % 4 + 1] AS sex, (['US', NULL, NULL, 'FR', NULL])[k % 5 + 1] AS occurred, (['DE', NULL, 'JP'])[k % 3 + 1] AS reported FROM orders),
parsed AS (SELECT *, CASE WHEN age_0 BETWEEN 0 AND 120 THEN age_0 END AS age_years, CASE WHEN wt_0 > 0 AND wt_0 < 650 THEN wt_0 END AS weight_kg,
    CASE length(event_dt_raw) WHEN 8 THEN 'day' WHEN 6 THEN 'month' WHEN 4 THEN 'year' ELSE 'missing' END AS event_dt_precision,
    CAST(try_strptime(CASE length(event_dt_raw) WHEN 8 THEN event_dt_raw WHEN 6 THEN event_dt_raw || '01' WHEN 4 THEN event_dt_raw || '0101' END, '%Y%m%d') AS DATE) AS event_dt FROM raw)"""


@query(_RAW + "SELECT k AS primaryid, round(age_years, 9) AS age_years, round(weight_kg, 9) AS weight_kg, sex, coalesce(occurred, reported) AS country, CASE WHEN occurred IS NOT NULL THEN 'occurrence' WHEN reported IS NOT NULL THEN 'reporter' ELSE 'none' END AS country_source FROM parsed")
def parse_demographics(c):
    return rounded(parse.demo(_raw_demo(c)).select("primaryid", "age_years", "weight_kg", "sex", "country", "country_source"), 9)


@query(_RAW + "SELECT k AS primaryid, event_dt_raw, CAST(event_dt AS VARCHAR) AS event_dt, event_dt_precision FROM parsed")
def parse_partial_dates(c):
    return parse.demo(_raw_demo(c)).select("primaryid", "event_dt_raw", F.col("event_dt").cast("string").alias("event_dt"), "event_dt_precision")


@query(
    _RAW
    + """SELECT count(*) AS rows, count(*) FILTER (WHERE age_years IS NULL) AS age_missing_or_unconvertible, count(*) FILTER (WHERE weight_kg IS NULL AND k % 5 <> 3) AS weight_missing_or_unconvertible, count(*) FILTER (WHERE k % 5 = 3) AS weight_implausible_unit,
    count(*) FILTER (WHERE sex IS NULL) AS sex_missing, count(*) FILTER (WHERE coalesce(occurred, reported) IS NULL) AS country_missing, count(*) FILTER (WHERE occurred IS NULL AND reported IS NOT NULL) AS country_from_reporter_fallback, count(*) FILTER (WHERE k % 5 = 2) AS country_stated_unknown, count(*) FILTER (WHERE event_dt_precision <> 'missing' AND event_dt IS NULL) AS event_dt_unparseable FROM parsed"""
)
def parse_null_tally(c):
    return parse.tally(_raw_demo(c), "DEMO")


@query(
    """,
st AS (SELECT o_orderkey AS k, o_orderkey // 2 AS caseid, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderkey % 2 END AS v FROM orders WHERE o_orderkey // 2 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0))
SELECT k AS primaryid, caseid, v AS caseversion FROM st QUALIFY row_number() OVER (PARTITION BY caseid ORDER BY v DESC NULLS LAST, k DESC) = 1"""
)
def stage1_survivors(c):
    withdrawn = c.table("customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("caseid"))
    return parse.latest_versions(parse.demo(_raw_demo(c)), withdrawn).select("primaryid", "caseid", "caseversion")


_OUTCOMES = "oc AS (SELECT l_orderkey AS primaryid, CASE l_linenumber WHEN 1 THEN 'HO' WHEN 2 THEN 'DE' WHEN 3 THEN NULL ELSE 'OT' END AS outc_cod FROM lineitem WHERE l_quantity > 30)"


@query(f""",
{_OUTCOMES},
s AS (SELECT primaryid, list_sort(list(DISTINCT outc_cod) FILTER (WHERE outc_cod IS NOT NULL)) AS codes, coalesce(bool_or(outc_cod = 'DE'), FALSE) AS death FROM oc GROUP BY 1)
SELECT c.primaryid, s.primaryid IS NOT NULL AS serious, coalesce(death, FALSE) AS serious_death, coalesce(array_to_string(codes, ','), '') AS codes FROM cases c LEFT JOIN s ON c.primaryid = s.primaryid""")
def seriousness(c):
    n = F.col("l_linenumber")
    oc = c.table("lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("primaryid"), F.when(n == 1, "HO").when(n == 2, "DE").when(n > 3, "OT").alias("outc_cod"))
    out = parse.attach_seriousness(dedup.latest_publication(c.publications()).select("primaryid"), oc)
    return out.select("primaryid", "serious", "serious_death", F.array_join("outcome_codes", ",").alias("codes"))


@query("SELECT primaryid, count(*) AS drugs FROM drugs WHERE primaryid IN (SELECT primaryid FROM cases WHERE caseversion = 1) GROUP BY primaryid")
def surviving_children(c):
    kept = dedup.latest_publication(c.publications()).filter("caseversion = 1")
    return parse.surviving(c.drugs(), kept).groupBy("primaryid").agg(F.count("*").alias("drugs"))


_MESSY = "concat('  ', p_name, chr(9), ' ', p_brand, CASE p_partkey % 4 WHEN 0 THEN ' 300MG tablet.' WHEN 1 THEN ' (852) 150 mg' WHEN 2 THEN ' and Widget/Ring' ELSE ' (NOS), ' END)"


def _messy(c) -> Column:
    k = F.col("p_partkey") % 4
    return F.concat(F.lit("  "), F.col("p_name"), F.lit("\t "), F.col("p_brand"), F.when(k == 0, " 300MG tablet.").when(k == 1, " (852) 150 mg").when(k == 2, " and Widget/Ring").otherwise(" (NOS), "))


@query(f"SELECT p_partkey, upper(trim(regexp_replace({_MESSY}, '\\s+', ' ', 'g'))) AS folded FROM part")
def text_fold(c):
    return c.table("part").select("p_partkey", text.fold(_messy(c)).alias("folded"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 > 1 THEN upper(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) END AS term FROM part")
def text_terms(c):
    """Terms with white space of several kinds; empty and blank ones are null."""
    k, name = F.col("p_partkey") % 5, F.regexp_replace("p_name", " ", " \t\n")
    return c.table("part").select("p_partkey", text.term(F.when(k == 0, "").when(k == 1, " \t ").otherwise(F.concat(F.lit(" "), name, F.lit("\r\n")))).alias("term"))


@query(
    f""",
f AS (SELECT p_partkey, p_partkey % 4 AS k, upper(trim(regexp_replace({_MESSY}, '\\s+', ' ', 'g'))) AS folded FROM part),
g AS (SELECT *, CASE k WHEN 0 THEN regexp_replace(folded, ' 300MG TABLET\\.$', '') WHEN 1 THEN regexp_replace(folded, ' \\(852\\) 150 MG$', '') WHEN 2 THEN folded ELSE regexp_replace(folded, ' \\(NOS\\),$', '') END AS cleaned FROM f)
SELECT p_partkey, folded, cleaned, CASE WHEN k = 2 THEN array_to_string(regexp_split_to_array(cleaned, '\\s*(/|\\bAND\\b)\\s*'), '|') ELSE cleaned END AS components,
    CASE k WHEN 0 THEN 'trailing_punctuation|dose_and_form' WHEN 1 THEN 'dose_and_form|uninformative_brackets' WHEN 2 THEN 'combination_split' ELSE 'trailing_punctuation|uninformative_brackets' END AS steps FROM g"""
)
def text_clean_drug_strings(c):
    part = c.table("part").select("p_partkey", "p_name", "p_brand")
    rows = drugnames.spread(part).select("p_partkey", drugnames.clean(_messy(c)).alias("x"))
    return rows.select("p_partkey", "x.folded", "x.cleaned", F.array_join("x.components", "|").alias("components"), F.array_join("x.steps", "|").alias("steps"))


# --- normalization ---


def _vocabulary(c):
    """Part names as concepts; every third is known by approximation only, the adjectives are its ingredients."""
    names = c.table("part").select(F.upper("p_name").alias("term")).distinct()
    tables = names.withColumn("rxcui", F.concat(F.lit("C"), F.length("term").cast("string"), F.substring("term", 1, 3))).withColumn("h", F.length("term") % 3)
    exact = tables.filter("h <> 0").select("term", "rxcui", F.col("term").alias("name"), F.lit("SBD").alias("tty"))
    near = tables.filter("h = 0").select("term", "rxcui", F.col("term").alias("name"), F.lit("SBD").alias("tty"), F.lit(2).alias("rank"), F.lit(7.5).alias("score"))
    first = F.substring_index("term", " ", 1)
    ingredients = tables.select("rxcui", F.concat(F.lit("I"), F.substring("term", 1, 3)).alias("ingredient_rxcui"), F.substring(first, 1, 3).alias("ingredient_name"), F.lit("IN").alias("ingredient_tty")).distinct()
    rule = c.spark.createDataFrame([("RED WIDGET", "not_a_drug", None, None), ("SMALL RING", "ingredient", "I999", "RINGIUM")], "folded string, disposition string, ingredient_rxcui string, ingredient_name string")
    return exact, near, ingredients, rule


def _matches(c) -> DataFrame:
    return rxnorm.match(rxnorm.cleaned_strings(c.drugs(), ("drugname_raw",)), *_vocabulary(c))


_MATCH = """,
m AS (SELECT upper(drugname_raw) AS folded, count(*) AS occurrences FROM drugs GROUP BY 1),
r AS (SELECT *, CASE folded WHEN 'RED WIDGET' THEN 'override_not_a_drug' WHEN 'SMALL RING' THEN 'override' ELSE CASE WHEN length(folded) % 3 = 0 THEN 'approximate' ELSE 'exact' END END AS method,
    CASE folded WHEN 'RED WIDGET' THEN NULL WHEN 'SMALL RING' THEN 'I999' ELSE concat('C', length(folded), substr(folded, 1, 3)) END AS rxcui,
    CASE folded WHEN 'RED WIDGET' THEN NULL WHEN 'SMALL RING' THEN 'RINGIUM' ELSE substr(folded, 1, 3) END AS ingredient FROM m)"""


@query(_MATCH + "SELECT folded, CAST(occurrences AS BIGINT) AS occurrences, method, rxcui, ingredient FROM r")
def rxnorm_match(c):
    return _matches(c).select("folded", F.col("occurrences").cast("bigint").alias("occurrences"), "method", "rxcui", F.get("ingredients", F.lit(0))["ingredient_name"].alias("ingredient"))


@query(_MATCH + "SELECT folded, method, rxcui, ingredient AS name FROM r")
def sink_normalization(c):
    """The three tables of a normalization, written twice as a whole and joined again as they are stored."""
    at = _folder(c, "normalization")
    for _ in range(2):
        rxnorm.store(_matches(c), at)
    matches, link, concepts = rxnorm.stored(c.spark, at)
    named = link.join(concepts.select("rxcui", "name"), "rxcui").select("folded", "name")
    return matches.join(named, "folded", "left").select("folded", "method", "rxcui", "name")


@query(
    _MATCH
    + """,
people AS (SELECT primaryid FROM cases ANTI JOIN superseded USING (primaryid)),
cd AS (SELECT DISTINCT primaryid, ingredient AS drug FROM drugs JOIN r ON upper(drugname_raw) = folded SEMI JOIN people USING (primaryid) WHERE role_cod IN ('PS', 'SS') AND ingredient IS NOT NULL),
cr AS (SELECT DISTINCT primaryid, pt FROM reactions SEMI JOIN people USING (primaryid))
SELECT drug, pt, count(*) AS a FROM cd JOIN cr USING (primaryid) GROUP BY drug, pt"""
)
def contingency_by_ingredient(c):
    tables = tuple(written(t, "normalized") for t in rxnorm.tables(_matches(c)))
    return contingency.build(c.publications(), c.drugs(), c.reactions(), c.duplicates(), contingency.Spec("ingredient"), tables).select("drug", "pt", "a")


# --- sources and sinks ---


@query("""SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS href FROM pages""")
def source_html_links(c):
    return links.anchors(c.table("pages").select("page_id", "html")).select("page_id", "href")


@query("SELECT primaryid, quarter, sex FROM published WHERE quarter >= '1999Q1' QUALIFY row_number() OVER (PARTITION BY primaryid ORDER BY quarter DESC) = 1 UNION ALL SELECT primaryid, quarter, 'OLD' FROM own2 WHERE primaryid NOT IN (SELECT primaryid FROM published WHERE quarter >= '1999Q1')".replace("own2", "(SELECT * FROM published WHERE quarter < '1999Q1' QUALIFY row_number() OVER (PARTITION BY primaryid ORDER BY quarter DESC) = 1)"))
def sink_upsert(c):
    rows = c.publications().select("primaryid", "quarter", "sex")
    old = dedup.latest_publication(rows.filter("quarter < '1999Q1'")).withColumn("sex", F.lit("OLD"))
    return store.upsert(old, rows.filter("quarter >= '1999Q1'"))


@query("SELECT primaryid, drug_seq, 'new' AS origin FROM drugs WHERE primaryid % 3 = 0 AND drug_seq = 1 UNION ALL SELECT primaryid, drug_seq, 'old' FROM drugs WHERE primaryid NOT IN (SELECT primaryid FROM drugs WHERE primaryid % 3 = 0 AND drug_seq = 1)")
def sink_replace_children(c):
    rows = c.drugs().select("primaryid", "drug_seq")
    return store.replace_children(rows.withColumn("origin", F.lit("old")), rows.filter("primaryid % 3 = 0 and drug_seq = 1").withColumn("origin", F.lit("new")))


_PAGES = "concat('<p><a href=\"', CASE page_id % 3 WHEN 0 THEN '/dl/' WHEN 1 THEN 'late/' ELSE 'https://h.org/' END, 'faers_ascii_', 2013 + page_id % 7, 'q', 1 + page_id % 4, '.zip\">x</a><a href=other.zip>')"


@query(
    f""",
l AS (SELECT page_id, concat(2013 + page_id % 7, 'Q', 1 + page_id % 4) AS quarter, concat('https://w.org/a/p', page_id, '.html') AS url, regexp_extract({_PAGES}, 'href="([^"]+)"', 1) AS href FROM pages),
f AS (SELECT quarter, arg_min(CASE WHEN href LIKE 'https:%' THEN href WHEN href LIKE '/%' THEN concat('https://w.org', href) ELSE concat('https://w.org/a/', href) END, url) AS link FROM l GROUP BY quarter)
SELECT quarter, link FROM f"""
)
def source_archive_links(c):
    pages = c.table("pages").select(F.concat(F.lit("https://w.org/a/p"), "page_id", F.lit(".html")).alias("url"), F.expr(_PAGES).alias("html"))
    return links.archives(pages)


def _folder(c, name: str) -> str:
    return f"{shared_dir(c.spark)}/{name}-{uuid.uuid4().hex}"


_LINES = _RAW + ", f AS (SELECT k, CASE WHEN k % 23 = 0 THEN 'old' ELSE CAST(k % 150 AS VARCHAR) END AS age, ([' f ', 'M', 'UNK', NULL])[k % 4 + 1] AS sex, CASE WHEN event_dt_raw <> '' THEN event_dt_raw END AS event_dt_raw FROM raw) "


@query(_LINES + "SELECT CAST(k AS VARCHAR) AS primaryid, age, sex, event_dt_raw FROM f")
def source_delimited(c):
    """Raw rows written as an extract's files with the declared header, and read by the scan."""
    fields, rows = source_fields("DEMO", Quarter(2026, 2)), _raw_demo(c)
    at = _folder(c, "extract")
    out = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None).cast("string")).alias(f.source) for f in fields))
    out.write.csv(at, sep="$", header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_table(c.spark, at, "DEMO", Quarter(2026, 2)).select("primaryid", "age", "sex", "event_dt_raw")


@query("SELECT o_orderkey % 6 AS kind, count(*) AS lines, CASE o_orderkey % 6 WHEN 0 THEN 'ascii' WHEN 1 THEN 'utf-8' WHEN 5 THEN NULL ELSE 'cp1252' END AS encoding FROM orders GROUP BY ALL")
def source_encodings(c):
    """Text files of six kinds: ASCII; UTF-8 of one to four bytes; CP1252; sequences cut by a line's end; overlong ones; bytes of no encoding."""
    at, key = _folder(c, "encodings"), F.col("o_orderkey")
    tail = F.element_at(F.array(*(F.unhex(F.lit(x)) for x in ("41", "C3A9E8AA9EF09F9880", "E9", "C3", "C0AF", "81"))), (key % 6 + 1).cast("int"))
    c.table("orders").select((key % 6).alias("kind"), F.concat(key.cast("string").cast("binary"), tail).cast("string").alias("value")).write.partitionBy("kind").text(at)
    return files.encodings(c.spark.read.text(at), "kind").select(F.col("kind").cast("bigint").alias("kind"), "lines", "encoding")


@query("SELECT DISTINCT upper(p_name) AS folded, CASE WHEN length(p_name) % 2 = 0 THEN 'ingredient' ELSE 'not_a_drug' END AS disposition, CASE WHEN length(p_name) % 2 = 0 THEN concat('7', length(p_name)) END AS ingredient_rxcui FROM part")
def source_overrides(c):
    """Rulings on drug strings as a CSV of many files, in which strings come several times and differ in case and white space."""
    at, even = _folder(c, "overrides"), F.length("p_name") % 2 == 0
    rows = c.table("part").select(
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), F.lower("p_name"))).otherwise(F.regexp_replace("p_name", " ", "  ")).alias("raw"),
        F.when(even, "ingredient").otherwise("not_a_drug").alias("disposition"),
        F.when(even, F.concat(F.lit(" 7"), F.length("p_name").cast("string"))).alias("ingredient_rxcui"),
        F.when(even, "NAME").alias("ingredient_name"),
        F.lit('seen, "twice"').alias("note"),
    )
    rows.write.csv(at, header=True, escape='"')
    return standards.overrides(c.spark, at).select("folded", "disposition", "ingredient_rxcui")


@query("SELECT p_name AS drug_name, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey AS VARCHAR) END AS rxcui, upper(n_name) AS pt, CAST(p_size % 2 AS INTEGER) AS label FROM part JOIN nation ON n_regionkey = p_partkey % 5")
def standards_pairs(c):
    """A reference standard as a CSV of many files, checked against the numbers it is said to have, with its outcomes' terms."""
    at, part = _folder(c, "standard"), c.table("part")
    said = part.agg(F.count_if(F.col("p_size") % 2 == 1), F.count_if(F.col("p_size") % 2 == 0)).first()
    rows = part.select(F.concat(F.lit(" "), "p_name").alias("drug_name"), F.when(F.col("p_partkey") % 4 > 0, F.concat(F.col("p_partkey").cast("string"), F.lit(" "))).alias("ingredient_rxcui"), F.concat(F.lit("o"), (F.col("p_partkey") % 5).cast("string")).alias("outcome_id"), (F.col("p_size") % 2).cast("string").alias("label"), F.lit("made").alias("source_note"))
    rows.write.csv(at, header=True)
    outcomes = c.table("nation").select(F.concat(F.lit("o"), F.col("n_regionkey").cast("string")).alias("outcome_id"), text.fold(F.col("n_name")).alias("pt"))
    found = standards.reference_set(c.spark, "made", at, outcomes, {"made": tuple(said)})
    return found.join(outcomes, "outcome_id").select("drug_name", F.col("ingredient_rxcui").alias("rxcui"), "pt", "label")


@query(", l AS (SELECT CASE c_custkey % 3 WHEN 0 THEN concat(' ', c_custkey, chr(9)) WHEN 1 THEN CAST(c_custkey AS VARCHAR) ELSE concat('x', c_custkey) END AS line FROM customer) SELECT DISTINCT CAST(trim(line, concat(' ', chr(9))) AS BIGINT) AS caseid FROM l WHERE line NOT LIKE 'x%'")
def source_deleted_cases(c):
    at, key = _folder(c, "deleted"), F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), key, F.lit("\t"))).when(F.col("c_custkey") % 3 == 1, key).otherwise(F.concat(F.lit("x"), key))
    c.table("customer").select(line.alias("value")).write.text(at)
    return files.read_deleted(c.spark, at)


@query("SELECT primaryid, drug_seq, role_cod, drugname_raw, prod_ai, CAST(NULL AS VARCHAR) AS route, quarter FROM drugs WHERE quarter <> '1995Q1'")
def store_quarters(c):
    """All quarters are written by one job; one is replaced by a second write and one deleted; the rest is read with the declared schema."""
    at, rows = _folder(c, "corpus"), c.drugs().withColumn("route", F.lit(None).cast("string"))
    store.replace_quarters(rows, at, "drug")
    store.replace_quarters(rows.filter("quarter = '1996Q2'"), at, "drug")
    store.delete_quarter(c.spark, at, "drug", "1995Q1")
    return store.read_dataset(c.spark, at, "drug")


@query(f""",
{_OUTCOMES},
s AS (SELECT primaryid, list_sort(list(DISTINCT outc_cod) FILTER (WHERE outc_cod IS NOT NULL)) AS codes, coalesce(bool_or(outc_cod = 'DE'), FALSE) AS death FROM oc GROUP BY 1)
SELECT CAST(c.primaryid AS VARCHAR) AS primaryid, coalesce(sex, '\\N') AS sex, CASE WHEN death THEN 'true' ELSE 'false' END AS serious_death, CASE WHEN len(codes) > 0 THEN concat('["', array_to_string(codes, '","'), '"]') ELSE '[]' END AS outcome_codes FROM cases c LEFT JOIN s ON c.primaryid = s.primaryid""")
def sink_rendered(c):
    n = F.col("l_linenumber")
    oc = c.table("lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("primaryid"), F.when(n == 1, "HO").when(n == 2, "DE").when(n > 3, "OT").alias("outc_cod"))
    return store.rendered(parse.attach_seriousness(dedup.latest_publication(c.publications()), oc).select("primaryid", "sex", "serious_death", "outcome_codes"))


@query(_pairs_sql("name") + _ESTIMATES + "SELECT drug, pt, a, b, c, d, n_cases, insufficient, flag_ror, flag_prr, flag_bcpnn, round(ror, 6) AS ror, round(ic025, 6) AS ic025 FROM scored")
def signal_run(c):
    """A run is built, written with its record and read back as the latest one."""
    at = _folder(c, "runs")
    signals.build(c.spark, at, RAW, lambda: _pairs(c))
    found = signals.read_run(c.spark, at, signals.latest_run(at))
    return rounded(found.select("drug", "pt", "a", "b", "c", "d", "n_cases", "insufficient", "flag_ror", "flag_prr", "flag_bcpnn", "ror", "ic025"))


@query(
    """,
q AS (SELECT quarter AS run_id, count(*) AS n, count(*) FILTER (WHERE sex = 'F') AS f, CAST(max(primaryid) AS DOUBLE) / 8 AS top, CAST(substr(quarter, 6, 1) AS INTEGER) AS k FROM published GROUP BY quarter)
SELECT run_id, n AS n_cases, CAST(CASE WHEN k <> 2 THEN f END AS VARCHAR) AS ror, CAST(CASE WHEN k <> 4 THEN f + 1 END AS VARCHAR) AS ror_prr_bcpnn, CASE WHEN k <> 3 THEN top END AS alpha1, CASE WHEN k = 1 THEN 'beta1' END AS bounds FROM q"""
)
def signal_records(c):
    """Records of runs, of which some lack keys, have them under a former name, as null or as another type, become one table."""
    at, quarter, k = _folder(c, "records"), F.col("quarter"), F.substring("quarter", 6, 1).cast("int")
    q = c.publications().groupBy("quarter").agg(F.count("*").alias("n"), F.count_if(F.col("sex") == "F").alias("f"), (F.max("primaryid").cast("double") / 8).alias("top"))
    counts = F.when(k == 1, F.to_json(F.struct(F.col("f").alias("ror"), (F.col("f") + 1).alias("three_of_four")))).when(k == 2, F.to_json(F.struct((F.col("f") + 1).alias("ror_prr_bcpnn"), F.lit(None).cast("string").alias("ror")), {"ignoreNullFields": "false"}))
    counts = counts.when(k == 3, F.to_json(F.struct(F.col("f").alias("ror"), (F.col("f") + 1).alias("ror_prr_bcpnn"), F.lit(-1).alias("three_of_four")))).otherwise(F.to_json(F.struct(F.col("f").alias("ror"))))
    prior = F.when(k == 3, F.lit('"none"')).otherwise(F.to_json(F.struct(F.col("top").alias("alpha1"), F.when(k == 1, F.array(F.lit("beta1"))).alias("on_boundary"))))
    text = F.concat(F.lit('{\n "run_id": "'), quarter, F.lit('",\n "n_cases": '), F.col("n").cast("string"), F.lit(',\n "flag_counts": '), counts, F.lit(',\n "prior": '), prior, F.lit("\n}"))
    q.select(quarter, text.alias("value")).repartition("quarter").write.partitionBy("quarter").text(at)
    found = signals.record_table(c.spark.read.text(at, wholetext=True))
    return found.select("run_id", "n_cases", *(F.col(n).cast("string").alias(n) for n in ("ror", "ror_prr_bcpnn")), "alpha1", F.array_join("on_boundary", ",").alias("bounds"))


@query("SELECT primaryid, quarter, caseid, caseversion FROM cases")
def stream_current_cases(c):
    """Publications arrive as files, the later ones in a second run of the stream, and keep a current table."""
    at, rows = _folder(c, "stream"), parse.dataset(c.publications(), "case")
    for part in (F.col("quarter") >= "1996Q1", F.col("quarter") < "1996Q1"):
        rows.filter(part).write.mode("append").parquet(f"{at}/in")
        stream.keep_current(stream.publications(c.spark, f"{at}/in"), f"{at}/now", f"{at}/mark").awaitTermination()
    return stream.read_current(c.spark, f"{at}/now").select("primaryid", "quarter", "caseid", "caseversion")
