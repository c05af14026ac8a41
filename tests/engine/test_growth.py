"""Steps whose work or traffic must not grow faster than their tables."""

import datetime
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from medsentry.functions import drugnames
from medsentry.operators import chains, estimators, mgps
from medsentry.plans import ingest, signals


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cycles_take_few_rounds_and_no_broadcast(spark, monkeypatch):
    rng, to = random.Random(3), {}
    for base in range(0, 600, 6):  # four around a cycle in any order, one that leads into it by another
        ring = rng.sample(range(base, base + 6), 6)
        to |= dict(zip(ring[:4], ring[1:4] + ring[:1], strict=True)) | {ring[4]: ring[5], ring[5]: ring[0]}
    to |= {i: i + 1 for i in range(1000, 1040)} | {2000 + i: 2000 + (i + 7) % 30 for i in range(30)}
    rounds, plain = [], chains.written

    def counted(df, name):
        rounds.append(name)
        assert name != "pointers" or "BroadcastHashJoin" not in plan(df)
        return plain(df, name)

    monkeypatch.setattr(chains, "written", counted)
    edges = spark.createDataFrame(list(to.items()), "primaryid bigint, canonical_primaryid bigint")
    out = chains.resolve(edges)
    assert "BroadcastHashJoin" not in plan(out)

    def walk(x):
        seen = []
        while x in to and x not in seen:
            seen.append(x)
            x = to[x]
        return (x, x, False, False) if x not in to else (None, min(seen[seen.index(x) :]), x == seen[0], True)

    assert {r.node: (r.root, r.component, r.on_cycle, r.closed) for r in out.collect()} == {x: walk(x) for x in {*to, *to.values()}}
    few = spark.createDataFrame([(i, i // 3 * 3 + (i + 1) % 3) for i in range(3000)], "primaryid bigint, canonical_primaryid bigint")
    rounds.clear()
    assert chains.resolve(few).filter("on_cycle and closed").count() == 3000
    assert rounds.count("pointers") <= 5  # of 13 that many rows would take


def test_divergence_scores_pairs_once(spark, monkeypatch):
    """The gamma functions run in batches, and the pairs that they need are scored once for the mean and the median."""
    cells = [(a, b, c, 1000 - a - b - c) for a in range(0, 9) for b in (0, 3, 50) for c in (0, 7)]
    table = spark.createDataFrame(cells, "a bigint, b bigint, c bigint, d bigint")
    plans, plain = [], signals.written
    monkeypatch.setattr(signals, "written", lambda df, name: plans.append(plan(df)) or plain(df, name))
    out = signals.ic_divergence(estimators.score(table))
    assert [p.count("ArrowEvalPython") for p in plans] == [1] and "ArrowEvalPython" not in plan(out)
    want = [abs(math.log2(a * 1000 / ((a + b) * (a + c))) - ic) for a, b, c, ic in ((r.a, r.b, r.c, r.ic) for r in estimators.score(table).collect()) if a]
    row = out.first()
    assert row.max_gap == pytest.approx(max(want)) and row.median_gap == pytest.approx(statistics.median(want)) and row.share_above_one == pytest.approx(sum(g > 1 for g in want) / len(want))


def test_cleaning_is_dealt_to_tasks_by_rows(spark):
    one = spark.range(5_000).coalesce(1)
    assert drugnames.spread(one).rdd.getNumPartitions() == 3 and drugnames.spread(one).count() == 5_000
    assert drugnames.spread(one.limit(0)).count() == 0


def test_a_pass_classifies_the_corpus_once(spark):
    """Its results and figures read tables: neither publications are reduced again, nor sets collected from drugs and reactions."""
    rows = [(i, i // 2, i % 2, "2020Q1", datetime.date(2020, 1, 1 + i), "F", 40.0 + i // 4 % 2, "US") for i in range(16)] + [(99, 99, 1, "2020Q1", datetime.date(2020, 2, 1), None, 40.0, "US")]
    cases = spark.createDataFrame(rows, "primaryid bigint, caseid bigint, caseversion bigint, quarter string, fda_dt date, sex string, age_years double, country string")
    drugs = spark.createDataFrame([(r[0], "A") for r in rows], "primaryid bigint, drugname_raw string")
    every, figures = ingest.duplicates(cases, drugs, drugs.select("primaryid", F.lit("P").alias("pt")))
    for df in (every, *figures.values()):
        assert "ExistingRDD" not in plan(df) and "LocalTableScan" not in plan(df)
    assert figures["population"].first().asDict() == {"evaluated": 17, "superseded": 8, "null_key": 1, "empty_drug_set": 0, "eligible": 8, "compared": 8, "alone": 0}
    assert figures["blocks"].first().asDict() == {"blocks": 2, "largest_block": 4, "naive_pairs": 12}
    assert {r.method: r.n for r in every.groupBy("method").agg(F.count("*").alias("n")).collect()} == {"version": 8, "probabilistic": 6} and figures["discarded"].first()[0] == 0


def test_derivatives_run_in_batches(spark):
    table = spark.range(50).selectExpr("id % 7 + 1 AS a", "0.5 + id % 5 AS expected").coalesce(1)
    theta = np.array([0.2, 0.06, 1.4, 1.8, 0.1])
    out = mgps.derivatives(table, [theta])
    assert "MapInPandas" in plan(out)
    n, e = (np.array(x, float) for x in zip(*table.collect(), strict=True))
    value, slope = mgps.nll(theta, n, e, np.ones(50))
    row = out.first()
    assert row.pairs == 50 and [row.log_likelihood, *row[3:]] == pytest.approx([-value, *-slope])
