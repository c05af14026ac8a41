"""Signal runs: the scored pair table of a specification, written once under its run id with its record."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import asdict
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..errors import EngineError
from ..operators import contingency, estimators, mgps
from ..operators.ranks import order_statistics
from ..sources.store import load_json, save_json
from ..storage import exists, names, written

COLUMNS = "run_id drug pt a b c d n_cases expected ror ror_lower ror_upper prr prr_lower prr_upper chi2 ic ic025 ic_observed_expected ic025_exact ebgm ebgm05 qn corrected insufficient flag_ror flag_prr flag_bcpnn flag_mgps flag_ror_prr_bcpnn flag_all_four".split()
#: Columns and keys under the names that early runs gave them.
FORMER = {"flag_three_of_four": "flag_ror_prr_bcpnn"}
CAVEAT = "Disproportionality raises hypotheses about reports; it does not establish causation."


def panel(table: DataFrame, prior: mgps.Prior, min_a: int = 3, adjudicated: bool = False) -> DataFrame:
    """All estimators and flags of a pair table."""
    return mgps.score(estimators.score(table, min_a), prior).withColumns(mgps.flags(prior, adjudicated))


_FLAGS = ("ror", "prr", "bcpnn", "mgps", "ror_prr_bcpnn", "all_four")


def flag_counts(scored: DataFrame, flags: tuple[str, ...] = _FLAGS) -> DataFrame:
    """One row: pairs flagged by each rule, with enough reports and in all. A count of a withheld flag is null."""
    out = [F.count("*").alias("pairs"), F.count_if("insufficient").alias("insufficient")]
    for f in flags:
        own = F.col(f"flag_{f}")
        withheld = F.count_if(own.isNull()) > 0
        out.append(F.when(~withheld, F.count_if(own & ~F.col("insufficient"))).alias(f))
        out.append(F.when(~withheld, F.count_if(own)).alias(f"{f}_including_insufficient"))
    return scored.agg(*out)


def ic_divergence(scored: DataFrame) -> DataFrame:
    """One row: how far the closed form lies from observed over expected, over pairs where both are finite; zeros if there are none."""
    gap = F.abs(F.col("ic_observed_expected") - F.col("ic"))
    finite = scored.filter((F.col("ic_observed_expected") > float("-inf")) & (F.col("ic_observed_expected") < float("inf")))
    rows = written(finite.select(gap.alias("gap")), "gaps")  # it is used twice, and pairs cost far more than gaps
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    sums = rows.agg(zero(F.max("gap")).alias("max_gap"), zero(F.avg((F.col("gap") > 1).cast("double"))).alias("share_above_one"))
    middle = order_statistics(rows, "gap", {"median_gap": 0.5})
    return sums.join(middle, F.lit(True)).select("max_gap", zero(F.col("median_gap")).alias("median_gap"), "share_above_one")  # one row each


def quantiles(scored: DataFrame, column: str) -> DataFrame:
    """One row of p50, p90, p99 and the maximum over pairs with enough reports."""
    return order_statistics(scored.filter("not insufficient"), column, {"p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0})


def new_run_id(root: str | Path) -> str:
    """UTC to the second; a suffix if that second has a run already."""
    base = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    name, k = base, 1
    while exists(f"{root}/run={name}"):
        name, k = f"{base}-{k}", k + 1
    return name


def build(spark: SparkSession, root: str, spec: contingency.Spec, make: Callable[[], DataFrame], adjudicated: bool = False, snapshot: dict | None = None) -> dict:
    """Score the pair table that ``make`` returns and write it as a new run; other runs are never touched."""
    began, run_id = time.time(), new_run_id(root)
    table = written(make(), "pairs")
    prior = mgps.fit(table, allow_boundary=True)
    scored = panel(table, prior, spec.min_a, adjudicated).withColumn("run_id", F.lit(run_id)).select(*COLUMNS)
    at = f"{root}/run={run_id}"
    scored.drop("run_id").write.mode("errorifexists").option("compression", "zstd").parquet(at)
    done = read_run(spark, root, run_id)
    counts, gaps = flag_counts(done).first().asDict(), ic_divergence(done).first().asDict()
    n_cases = done.agg(F.max("n_cases")).first()[0]
    record = {"run_id": run_id, "created_at": datetime.now(timezone.utc).isoformat(), "code": __version__, "params": spec.params() | {"mgps_adjudicated": adjudicated}, "data_snapshot": snapshot, "n_cases": n_cases, "pairs_written": counts["pairs"], "flag_counts": counts, "ic_divergence": gaps, "prior": asdict(prior), "seconds": time.time() - began, "caveat": CAVEAT}
    save_json(f"{root}/records/{run_id}.json", record)
    return record


def runs(root: str | Path) -> list[str]:
    return [n[4:] for n in names(root) if n.startswith("run=")]


def latest_run(root: str | Path) -> str:
    if not (found := runs(root)):
        raise EngineError(f"{root} has no runs")
    return found[-1]


def read_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    if run_id not in runs(root):
        raise EngineError(f"{root} has no run {run_id}")
    df = spark.read.parquet(f"{root}/run={run_id}")
    for old, new in FORMER.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.withColumn("run_id", F.lit(run_id))


def read_record(root: str | Path, run_id: str) -> dict:
    return load_json(f"{root}/records/{run_id}.json", FORMER)


#: Columns of the table of records: type and where the value is; a second place is what early runs called it.
_RECORD = {
    "run_id": ("string", "run_id"),
    "created_at": ("string", "created_at"),
    "code": ("string", "code"),
    "drug_key": ("string", "params.drug_key"),
    "roles": ("string", "params.roles"),
    "n_cases": ("bigint", "n_cases"),
    "pairs_written": ("bigint", "pairs_written"),
    **{f: ("bigint", f"flag_counts.{f}") for f in ("ror", "prr", "bcpnn", "mgps", "all_four")},
    "ror_prr_bcpnn": ("bigint", "flag_counts.ror_prr_bcpnn", "flag_counts.three_of_four"),
    **{f: ("double", f"ic_divergence.{f}") for f in ("max_gap", "median_gap", "share_above_one")},
    **{f: ("double", f"prior.{f}") for f in (*mgps.NAMES, "nll")},
    "on_boundary": ("array<string>", "prior.on_boundary"),
    "seconds": ("double", "seconds"),
}


def record_table(texts: DataFrame) -> DataFrame:
    """A row a run of its JSON record (value), under the present names. What a record lacks, or has of another type, is null: unmeasured isn't zero.

    Text that is no JSON gives a row of nulls.
    """
    found = texts.select(F.try_parse_json("value").alias("r"))
    own = lambda kind, *places: F.coalesce(*(F.try_variant_get("r", f"$.{p}", kind) for p in places))
    return found.select(*(own(*spec).alias(name) for name, spec in _RECORD.items()))


def records(spark: SparkSession, root: str) -> DataFrame:
    """The records of all runs as a table, read by executors."""
    return record_table(spark.read.text(f"{root}/records", wholetext=True, pathGlobFilter="*.json"))


def adjudicated_counts(spark: SparkSession, root: str, run_id: str, diagnostic: dict) -> dict:
    """The conjunction's counts from stored flags, once a diagnostic shows that the bound is the optimum; else why they stay withheld."""
    if not diagnostic.get("bound_is_optimum"):
        return {"all_four": None, "withheld": f"the likelihood at the bound of {diagnostic.get('parameter')} is not the best of the grid"}
    four = F.col("flag_ror_prr_bcpnn") & F.col("flag_mgps")
    row = read_run(spark, root, run_id).agg(F.count_if(four & ~F.col("insufficient")).alias("all_four"), F.count_if(four).alias("all_four_including_insufficient")).first()
    return row.asDict() | {"withheld": None}


def history(root: str | Path, path: str | Path, diagnostic: dict | None = None, spark: SparkSession | None = None) -> dict:
    """Write the artifact of all runs, with the conjunction adjudicated where a diagnostic allows it."""
    out = {"caveat": CAVEAT, "diagnostic": diagnostic, "runs": []}
    for run_id in runs(root):
        record = read_record(root, run_id)
        if diagnostic and spark and record["prior"]["on_boundary"]:
            record["adjudication"] = adjudicated_counts(spark, str(root), run_id, diagnostic)
        out["runs"].append(record)
    save_json(path, out)
    return out


def diagnose(spark: SparkSession, root: str, run_id: str, prior: mgps.Prior, parameter: str = "alpha1", points: int = 19) -> dict:
    """Profile one parameter from its bound upward and compare the bound with the grid's best point.

    The comparison decides; whether the profile is monotone is only reported. EBGM05 is scored at the
    bound and at the best point and the flagged pairs are counted at both.
    """
    scored = read_run(spark, root, run_id)
    k = mgps.NAMES.index(parameter)
    grid = [float(mgps.LOW[k] * (1e4 if parameter != "p" else 1e3) ** (i / (points - 1))) for i in range(points)]
    rows = mgps.profile_of(mgps.points(scored), parameter, grid, prior.theta)
    best = min(rows, key=lambda r: r["nll"])
    at_bound = min((r for r in rows if r["value"] == grid[0]), key=lambda r: r["nll"], default=None)
    if at_bound is None:
        raise EngineError("the profile has no point at the bound")
    forward = [r["nll"] for r in rows if r["direction"] == "forward"]
    cells = scored.select("a", "expected", "insufficient")
    flagged, spread = {}, {}
    for name, row in (("bound", at_bound), ("argmin", best)):
        own = mgps.score(cells, mgps.Prior(*row["theta"]))
        flagged[name] = own.filter("ebgm05 > 2 and not insufficient").count()
        spread[name] = quantiles(own, "ebgm05").first().asDict()
    return {"parameter": parameter, "grid": grid, "profile": rows, "bound_nll": at_bound["nll"], "argmin": best["value"], "argmin_nll": best["nll"], "bound_is_optimum": at_bound["nll"] <= best["nll"] + 1e-6 * max(1, abs(best["nll"])), "monotone": all(x <= y + 1e-9 for x, y in zip(forward, forward[1:], strict=False)), "flagged": flagged, "ebgm05": spread, "finite": math.isfinite(best["nll"])}
