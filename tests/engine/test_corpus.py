"""Parsing, deduplication, chains, files and runs on small hand-made corpora."""

import datetime as dt
import itertools
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from medsentry import storage
from medsentry.errors import EngineError, IngestError, NormalizationError, ReferenceSetError, SchemaMismatchError
from medsentry.functions import drugnames, text
from medsentry.operators import chains, contingency, dedup, parse, rxnorm
from medsentry.plans import ingest, quality, signals
from medsentry.sources import files, links, schema, standards, store
from medsentry.sources.quarter import Quarter
from medsentry.streaming import cases as streaming


def one(spark, column, *values):
    names = [f"x{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(column(*(F.col(n) for n in names)).alias("y")).first().y


@pytest.mark.parametrize(
    ("value", "unit", "years"),
    [("5", "DEC", 50), ("42", "YR", 42), ("18", "MON", 1.5), ("52", "WK", 52 / 52.1775), ("365", "DY", 365 / 365.25), ("24", "HR", 24 / 8766), ("60", "MIN", 60 / 525960), ("30", "SEC", 30 / 31557600), ("999", "YR", None), ("13", "DEC", None), ("-5", "YR", None), ("42", "", None), ("", "YR", None), ("old", "YR", None), ("120", "YR", 120)],
)
def test_ages(spark, value, unit, years):
    assert one(spark, text.age_in_years, value, unit) == pytest.approx(years)


@pytest.mark.parametrize(("value", "unit", "kg"), [("70", "KG", 70), ("154", "LBS", 154 * 0.45359237), ("3200", "GMS", 3.2), ("1", "YEARS", None), ("0", "KG", None), ("900", "KG", None)])
def test_weights(spark, value, unit, kg):
    assert one(spark, text.weight_in_kg, value, unit) == pytest.approx(kg)


@pytest.mark.parametrize(("raw", "day", "precision"), [("20130215", dt.date(2013, 2, 15), "day"), ("201302", dt.date(2013, 2, 1), "month"), ("2013", dt.date(2013, 1, 1), "year"), (None, None, "missing"), ("", None, "missing"), ("2013021", None, "missing"), ("20130231", None, "day")])
def test_dates(spark, raw, day, precision):
    assert (one(spark, text.partial_date, raw), one(spark, text.date_precision, raw)) == (day, precision)


def test_terms(spark):
    assert one(spark, text.term, "  drug   hypersensitivity ") == "DRUG HYPERSENSITIVITY" and one(spark, text.term, " ") is None
    assert one(spark, text.country, " us ") == "US" and one(spark, text.country, "Country not specified") is None


@pytest.mark.parametrize(
    ("raw", "cleaned", "parts"),
    [("RANITIDINE.", "RANITIDINE", 1), ("...", "...", 1), ("VITAMIN B-12", "VITAMIN B-12", 1), ("RANITIDINE HYDROCHLORIDE (852)", "RANITIDINE HYDROCHLORIDE", 1), ("ASCORBIC ACID (VITAMIN C)", "ASCORBIC ACID (VITAMIN C)", 1), ("SOLIRIS 300MG", "SOLIRIS", 1), ("CAPECITABINE TAB 500MG", "CAPECITABINE", 1), ("HUMIRA 40 MG/0.8 ML PEN", "HUMIRA", 1), ("500MG", "500MG", 1), ("HYDROCODONE/ACETAMINOPHEN", "HYDROCODONE/ACETAMINOPHEN", 2), ("VITAMIN B1/B6", "VITAMIN B1/B6", 1), ("OXYCODONE HCL TABLETS (RHODES 91?490)", "OXYCODONE HCL", 1)],
)
def test_clean(spark, raw, cleaned, parts):
    x = one(spark, drugnames.clean, raw)
    assert (x.cleaned, len(x.components)) == (cleaned, parts)


def test_clean_steps(spark):
    assert one(spark, drugnames.clean, "  ranitidine hydrochloride (852) 150mg tablet.  ").steps == ["trailing_punctuation", "dose_and_form", "uninformative_brackets"]


def test_quarters():
    q = Quarter.parse("2013Q4")
    assert q.next().label == "2014Q1" and q.previous().label == "2013Q3" and q.suffix == "13Q4"
    assert [x.label for x in Quarter(2013, 3).until(Quarter(2014, 1))] == ["2013Q3", "2013Q4", "2014Q1"]
    for bad in ("2013", "2013Q5", "1999Q1"):
        with pytest.raises(IngestError):
            Quarter.parse(bad)


def test_headers():
    q = Quarter(2013, 1)
    names = [f.source for f in schema.source_fields("DEMO", q)]
    assert len(names) == 22 and len(schema.source_fields("DEMO", Quarter(2026, 2))) == 25
    schema.check_header("DEMO", q, [f" {n} " for n in names])
    with pytest.raises(SchemaMismatchError, match="missing.*sex|missing.*gndr_cod"):
        schema.check_header("DEMO", q, ["sex" if n == "gndr_cod" else n for n in names])
    with pytest.raises(SchemaMismatchError, match="order"):
        schema.check_header("DEMO", q, names[::-1])


def corpus(spark, rows, drugs, reactions=None):
    c = spark.createDataFrame(rows, "primaryid bigint, caseid bigint, caseversion bigint, fda_dt date, sex string, country string, age_years double, quarter string")
    d = spark.createDataFrame([(p, x) for p, xs in drugs.items() for x in xs], "primaryid bigint, drugname_raw string")
    r = spark.createDataFrame([(p, x) for p in (reactions or {k[0]: None for k in rows}) for x in ((reactions or {}).get(p) or ("NAUSEA", "HEADACHE"))], "primaryid bigint, pt string")
    return c, d, r


DAY = dt.date(2013, 1, 5)


def test_constructed(spark):
    rows = [(100011, 10001, 1, DAY, "F", "US", 40.0, "2013Q1"), (200011, 20001, 1, DAY, "F", "US", 40.0, "2013Q1"), (300011, 30001, 1, DAY, "F", "US", 40.0, "2013Q1"), (100012, 10001, 2, dt.date(2013, 4, 5), "F", "US", 40.0, "2013Q2")]
    c, d, r = corpus(spark, rows, {100011: ["ASPIRIN"], 200011: ["ASPIRIN"], 100012: ["ASPIRIN"]})
    every, figures = ingest.duplicates(c, d, r)
    got = {x.primaryid: (x.canonical_primaryid, x.method) for x in every.collect()}
    assert got == {100011: (100012, "version"), 200011: (100012, "probabilistic")}
    p = figures["population"].first()
    assert (p.evaluated, p.superseded, p.empty_drug_set, p.eligible, p.compared, p.alone) == (4, 1, 1, 2, 2, 0)


def test_tied(spark):
    ids = (100011, 200011, 300011, 400011)
    c, d, r = corpus(spark, [(i, i // 10, 1, DAY, "F", "US", 51.0, "2013Q1") for i in ids], {i: ["ASPIRIN", "WARFARIN"] for i in ids})
    every, _ = ingest.duplicates(c, d, r)
    assert {(x.primaryid, x.canonical_primaryid) for x in every.collect()} == {(i, 400011) for i in ids[:3]}


def test_chained(spark, tmp_path):
    ten = [f"DRUG{i:02d}" for i in range(1, 11)]
    sets = {100021: ten, 200021: [*ten[:9], "DRUG11"], 300021: [*ten[:8], "DRUG11", "DRUG12"]}
    c, d, r = corpus(spark, [(i, i // 10, 1, DAY, "M", "US", 33.0, "2013Q1") for i in sets], sets)
    every, _ = ingest.duplicates(c, d, r)
    assert {(x.primaryid, x.canonical_primaryid) for x in every.collect()} == {(100021, 200021), (200021, 300021)}
    found = ingest.persist(every, str(tmp_path / "duplicate"))
    assert found["sound"] and found["components"] == 1 and found["pointers"] == 2


@pytest.mark.parametrize("rarest", [True, False])
def test_similarity_join_is_exact(spark, rarest):
    rng = random.Random(3)
    sets = {i: (sorted(rng.sample("abcdefg", rng.randint(0, 6))), sorted(rng.sample("uvwxyz", rng.randint(0, 5)))) for i in range(120)}
    df = spark.createDataFrame([(i, i // 2, "F" if i % 2 else "M", 40.0, "US", "2013Q1", "d", *s) for i, s in sets.items()], "primaryid bigint, caseid bigint, sex string, age_r double, country string, quarter string, fda_dt string, drugs array<string>, reactions array<string>")
    near = lambda a, b: bool(a and b) and 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b})
    want = {(i, j) for i, j in itertools.combinations(sets, 2) if i % 2 == j % 2 and i // 2 != j // 2 and near(sets[i][0], sets[j][0]) and near(sets[i][1], sets[j][1])}
    assert {(r.l, r.r) for r in dedup.similar_pairs(df, rarest=rarest).collect()} == want and want


def test_one_common_reaction_makes_no_candidates(spark):
    """50,000 classes of one block that share their only reaction, with disjoint drugs; and some that really are alike."""
    rows = spark.range(50_000).selectExpr("id as primaryid", "'F' as sex", "40.0 as age_r", "'US' as country", "array('NAUSEA') as reactions", "array(concat('D', id), concat('E', id)) as drugs")
    assert dedup.candidates(rows, second="drugs").count() == 0
    alike = rows.filter("primaryid < 3").selectExpr("primaryid + 90000 as primaryid", "sex", "age_r", "country", "reactions", "drugs")
    assert {tuple(r) for r in dedup.candidates(rows.unionByName(alike), second="drugs").collect()} == {(i, i + 90000) for i in range(3)}


@pytest.mark.parametrize("rarest", [True, False])
@pytest.mark.parametrize("second", ["drugs", None])
def test_candidates_lose_no_similar_pair(spark, rarest, second):
    rng = random.Random(5)
    near = lambda a, b: bool(a and b) and 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b})
    base = [[f"t{i}" for i in rng.sample(range(40), rng.randint(1, 14))] for _ in range(25)]
    change = lambda s: sorted({*s} - {rng.choice(s)} | ({f"t{rng.randrange(40)}"} if rng.random() < 0.5 else set())) if rng.random() < 0.6 else sorted(s)
    sets = {i: (change(base[i % 25]), change(base[(i * 3) % 25])) for i in range(200)}
    df = spark.createDataFrame([(i, "F", 40.0, "US", *s) for i, s in sets.items()], "primaryid bigint, sex string, age_r double, country string, drugs array<string>, reactions array<string>")
    want = {(i, j) for i, j in itertools.combinations(sets, 2) if near(sets[i][1], sets[j][1]) and (not second or near(sets[i][0], sets[j][0]))}
    got = [tuple(r) for r in dedup.candidates(df, rarest=rarest, second=second).collect()]
    assert want and want <= {*got} and len({*got}) == len(got) and len(got) < 200 * 199 / 4


def test_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (7, 6)], "primaryid bigint, canonical_primaryid bigint")
    rows = {r.node: (r.root, r.component, r.on_cycle, r.closed) for r in chains.resolve(edges).collect()}
    assert rows == {1: (None, 1, True, True), 2: (None, 1, True, True), 3: (None, 1, True, True), 4: (None, 1, False, True), 5: (6, 6, False, False), 6: (6, 6, False, False), 7: (6, 6, False, False)}
    with pytest.raises(EngineError):
        chains.resolve(edges.union(edges.sparkSession.createDataFrame([(1, 9)], edges.schema)))


def test_versions_and_withdrawals(spark):
    df = spark.createDataFrame([(1, 100, 1), (2, 100, 2), (3, 200, 1), (4, None, 1)], "primaryid bigint, caseid bigint, caseversion bigint")
    gone = spark.createDataFrame([(200,)], "caseid bigint")
    assert sorted(r.primaryid for r in parse.latest_versions(df).collect()) == [2, 3, 4]
    assert sorted(r.primaryid for r in parse.latest_versions(df, gone).collect()) == [2, 4]


def test_seriousness(spark):
    rows = spark.createDataFrame([(1, "HO"), (1, "DE"), (2, "OT"), (3, None)], "primaryid bigint, outc_cod string")
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "primaryid bigint")
    got = {r.primaryid: (r.serious, r.serious_death, r.outcome_codes) for r in parse.attach_seriousness(cases, rows).collect()}
    assert got == {1: (True, True, ["DE", "HO"]), 2: (True, False, ["OT"]), 3: (True, False, []), 4: (False, False, [])}


def quarter_folder(root, q, encoding="ascii", name="M"):
    at = root / "ascii"
    at.mkdir(parents=True)
    wanted = {"DEMO": {"primaryid": "11", "caseid": "1", "caseversion": "1", "age": "40", "age_cod": "YR", "sex": "F", "occr_country": "US", "fda_dt": "20260102"}, "DRUG": {"primaryid": "11", "drug_seq": "1", "role_cod": "PS", "drugname": 'ASP"IRIN'}, "REAC": {"primaryid": "11", "pt": "nausea"}, "OUTC": {"primaryid": "11", "outc_cod": "DE"}, "INDI": {"primaryid": "11", "indi_pt": "pain"}, "RPSR": {"primaryid": "11"}, "THER": {"primaryid": "99", "start_dt": "2026"}}
    for table, values in wanted.items():
        names = [f.source for f in schema.source_fields(table, q)]
        if table == "DEMO":
            values |= {"mfr_sndr": name}
        lines = ["$".join(names), "$".join(values.get(n, "") for n in names), "$".join("12" if n == "primaryid" else "2" if n == "caseid" else values.get(n, "") for n in names)]
        (at / f"{table}{q.suffix}.txt").write_bytes("\r\n".join([*lines, ""]).encode(encoding))
    (root / "Deleted").mkdir()
    (root / "Deleted" / "DELETE.txt").write_text("\n2\nx\n")
    return root


@pytest.mark.parametrize(("encoding", "name"), [("ascii", "M"), ("utf-8", "MÜLLER"), ("cp1252", "MÜLLER"), ("cp1252", "MÜLLER – 5 € “Žižka™”")])
def test_ingest(spark, tmp_path, encoding, name):
    q = Quarter(2026, 2)
    folder, root = quarter_folder(tmp_path / "in", q, encoding, name), str(tmp_path / "out")
    assert files.encoding_of(files.find_file(folder, "DEMO")) == encoding
    assert [r.mfr_sndr for r in files.read_table(spark, files.find_file(folder, "DEMO"), "DEMO", q).collect()] == [name] * 2
    for _ in range(2):
        report = ingest.ingest_quarter(spark, folder, root, q)
    assert report["rows"] == {"case": 1, "drug": 1, "reaction": 1, "outcome": 1, "therapy": 0, "indication": 1, "report_source": 1} and report["had_deleted_file"]
    case = store.read_dataset(spark, root, "case").first()
    assert (case.primaryid, case.quarter, case.serious_death, case.country, case.age_years) == (11, "2026Q2", True, "US", 40.0)
    assert store.read_dataset(spark, root, "drug").first().drugname_raw == 'ASP"IRIN'
    assert "pt_missing" in quality.render(quality.build([report], None, {})) and quality.rates(None, {})["stage2"]["rate"] is None


def test_unknown_age_unit(spark):
    with pytest.raises(IngestError, match="FORTNIGHT"):
        parse.check_age_units(spark.createDataFrame([("FORTNIGHT",)], "age_cod string"))


def test_manifest(tmp_path):
    m = store.Manifest(tmp_path / "m.json")
    assert m.should_ingest("2013Q1", "a")
    m.start("2013Q1", "a")
    assert m.should_ingest("2013Q1", "a")
    m.complete("2013Q1", {"case": 3}, False)
    m = store.Manifest(tmp_path / "m.json")
    assert not m.should_ingest("2013Q1", "a") and m.should_ingest("2013Q1", "b") and m.should_ingest("2013Q1", "a", force=True)
    assert m.completed("2013Q1") == ["2013Q1"] and m.completed("2014Q1") == []


def test_small_files(spark, tmp_path):
    at = f"file://{tmp_path}/folder/x.json"
    assert not storage.exists(at) and storage.names(f"file://{tmp_path}/folder") == []
    for value in ("a", "é\n", ""):
        storage.write_text(at, value)
        assert storage.read_text(at) == value
    assert [n for n in storage.names(f"file://{tmp_path}/folder") if not n.startswith(".")] == ["x.json"]


def test_run_round_trip(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, i, 1, DAY, "F", "US", 40.0, "2013Q1") for i in range(300)]
    c, d, r = corpus(spark, rows, {i: rng.sample("ABCDEFGH", 2) for i in range(300)}, {i: rng.sample("UVWXYZ", 2) for i in range(300)})
    d = d.withColumn("role_cod", F.lit("PS"))
    none = spark.createDataFrame([], "primaryid bigint")
    make = lambda: contingency.build(c, d, r, none, contingency.Spec("raw_string"))
    record = signals.build(spark, str(tmp_path), contingency.Spec("raw_string"), make)
    again = signals.build(spark, str(tmp_path), contingency.Spec("raw_string"), make)
    assert record["run_id"] != again["run_id"] and signals.latest_run(tmp_path) == again["run_id"]
    df = signals.read_run(spark, str(tmp_path), record["run_id"])
    assert sorted(df.columns) == sorted(signals.COLUMNS) and df.count() == record["pairs_written"] == 48
    assert df.filter("a + b + c + d <> n_cases").count() == 0
    assert signals.read_record(tmp_path, record["run_id"])["n_cases"] == 300
    assert len(signals.history(tmp_path, tmp_path / "h.json")["runs"]) == 2 and json.loads((tmp_path / "h.json").read_text())
    with pytest.raises(EngineError):
        signals.read_run(spark, str(tmp_path), "nope")


def test_normalization(spark):
    strings = rxnorm.cleaned_strings(spark.createDataFrame([("Aspirin 100 mg",), ("ASPIRIN/CODEINE",), ("xyz",), ("HERBAL TEA",)], "drugname_raw string"), ("drugname_raw",))
    exact = spark.createDataFrame([("ASPIRIN", "1", "ASPIRIN", "IN")], "term string, rxcui string, name string, tty string")
    near = spark.createDataFrame([("CODEINE", "8", "X", "SBD", 1, 9.0), ("CODEINE", "2", "Y", "SBD", 2, 8.0)], "term string, rxcui string, name string, tty string, rank int, score double")
    ing = spark.createDataFrame([("1", "1", "ASPIRIN", "IN"), ("2", "22", "CODEINE", "IN")], "rxcui string, ingredient_rxcui string, ingredient_name string, ingredient_tty string")
    rule = spark.createDataFrame([("HERBAL TEA", "not_a_drug", None, None)], "folded string, disposition string, ingredient_rxcui string, ingredient_name string")
    got = {r.folded: (r.method, r.rxcui, [i.ingredient_name for i in r.ingredients], r["rank"], r.components_matched) for r in rxnorm.match(strings, exact, near, ing, rule).collect()}
    assert got == {"ASPIRIN 100 MG": ("exact", "1", ["ASPIRIN"], None, 1), "ASPIRIN/CODEINE": ("approximate", None, ["ASPIRIN", "CODEINE"], 2, 2), "XYZ": ("unmatched", None, [], None, 0), "HERBAL TEA": ("override_not_a_drug", None, [], None, 0)}


def test_standards(spark, tmp_path):
    (tmp_path / "outcomes.yaml").write_text("mi:\n  - Myocardial infarction\n  - Acute MI\ngi: [GI bleed]\n")
    head = "drug_name,ingredient_rxcui,outcome_id,label,source_note\n"
    (tmp_path / "omop.csv").write_text(head + "a,1,mi,1,x\nb,,gi,0,x\n")
    want = {"omop": (1, 1)}
    rows = standards.reference_sets(spark, tmp_path, ("omop",), want).collect()
    assert [(r.drug_name, r.ingredient_rxcui, r.label) for r in rows] == [("a", "1", 1), ("b", None, 0)]
    with pytest.raises(ReferenceSetError, match="published"):
        standards.reference_sets(spark, tmp_path, ("omop",))
    with pytest.raises(ReferenceSetError, match="harpaz.*euadr"):
        standards.reference_sets(spark, tmp_path)
    (tmp_path / "omop.csv").write_text(head + "a,1,nowhere,1,x\n")
    with pytest.raises(ReferenceSetError, match="nowhere"):
        standards.reference_sets(spark, tmp_path, ("omop",), {"omop": (1, 0)})
    (tmp_path / "o.csv").write_text("raw,disposition,ingredient_rxcui,ingredient_name,note\nTea,not_a_drug,,,n\n tea ,ingredient,7,TEA,n\n")
    assert [(r.folded, r.ingredient_rxcui) for r in standards.overrides(spark, str(tmp_path / "o.csv")).collect()] == [("TEA", "7")]
    (tmp_path / "o.csv").write_text("raw,disposition,ingredient_rxcui,ingredient_name,note\nTea,maybe,,,n\n")
    with pytest.raises(NormalizationError):
        standards.overrides(spark, str(tmp_path / "o.csv"))


def test_links(spark, tmp_path):
    html = '<a class=x href="/dl/faers_ascii_2013q1.zip">1</a><a href="https://h/FAERS_ASCII_2014Q2.ZIP">2</a><a href="other.zip">3</a><a href="late/faers_ascii_2013q1.zip">4</a>'
    pages = spark.createDataFrame([("https://h.org/a/b.html?x", html)], "url string, html string")
    assert {r.quarter: r.link for r in links.archives(pages).collect()} == {"2013Q1": "https://h.org/dl/faers_ascii_2013q1.zip", "2014Q2": "https://h/FAERS_ASCII_2014Q2.ZIP"}
    assert links.cached(tmp_path / "c.json", lambda: {"2013Q1": "u"}) == links.cached(tmp_path / "c.json", dict)
    with pytest.raises(IngestError):
        links.cached(tmp_path / "d.json", dict)


def test_streaming_upsert(spark, tmp_path, monkeypatch):
    kind, table = schema.DATASETS["case"], str(tmp_path / "now")
    make = lambda p, q: tuple(p if f.name == "primaryid" else q if f.name == "quarter" else None for f in kind)

    def arrive(*rows):
        spark.createDataFrame([make(*r) for r in rows], kind).write.mode("append").parquet(str(tmp_path / "in"))
        return run()

    def run(buckets=4):
        streaming.keep_current(streaming.publications(spark, str(tmp_path / "in")), table, str(tmp_path / "mark"), buckets=buckets).awaitTermination()
        return sorted((r.primaryid, r.quarter) for r in streaming.read_current(spark, table).collect())

    assert streaming.read_current(spark, table).count() == 0
    assert arrive((1, "2013Q1"), (2, "2013Q1"), (2, "2013Q1"), (3, "2012Q1"), (3, "2012Q2")) == [(1, "2013Q1"), (2, "2013Q1"), (3, "2012Q2")]
    assert arrive((1, "2013Q2")) == [(1, "2013Q2"), (2, "2013Q1"), (3, "2012Q2")]
    # An older and a newer publication in one batch; then a batch that ends before its last step and is replayed.
    assert arrive((2, "2012Q4"), (2, "2014Q1"), (3, "2011Q1")) == [(1, "2013Q2"), (2, "2014Q1"), (3, "2012Q2")]
    write = streaming.write_text
    monkeypatch.setattr(streaming, "write_text", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        arrive((4, "2015Q1"))
    assert streaming.read_current(spark, table).count() == 3
    monkeypatch.setattr(streaming, "write_text", write)
    assert run() == [(1, "2013Q2"), (2, "2014Q1"), (3, "2012Q2"), (4, "2015Q1")]
    state = json.loads((tmp_path / "now/current.json").read_text())
    assert {p.name for p in (tmp_path / "now").glob("v=*")} == {f"v={v}" for v in (*state["versions"].values(), *state["replaced"].values())}
    with pytest.raises(Exception, match="buckets"):
        arrive((5, "2015Q1"))
        spark.createDataFrame([make(6, "2015Q1")], kind).write.mode("append").parquet(str(tmp_path / "in"))
        run(8)


def test_an_ended_rebuild_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.write_whole(spark.range(3), path)
    move, calls = store._move, []

    def ends(*args):
        calls.append(args)
        if len(calls) == 2:  # between the old table's move and the new one's
            raise RuntimeError("ended")
        move(*args)

    monkeypatch.setattr(store, "_move", ends)
    with pytest.raises(RuntimeError):
        store.write_whole(spark.range(5), path)
    monkeypatch.undo()
    assert store.recovered(spark, path) and spark.read.parquet(path).count() == 3
    store.write_whole(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and not (tmp_path / "t.old").exists()


def test_unset_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from medsentry import storage

    there = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"))
    with pytest.raises(EngineError, match="spark.checkpoint.dir"):
        storage.shared_dir(there)


def test_rows_without_a_case_id_are_one_case(spark):
    df = spark.range(3000).selectExpr("id as primaryid", "cast(null as bigint) as caseid", "id % 7 as caseversion", "cast(id as string) as note")
    assert [(r.primaryid, r.note) for r in parse.latest_versions(df).collect()] == [(2995, "2995")]


def test_more_drug_strings(spark):
    for raw, cleaned, n in (("A,AND B CREAM", "A,AND B", 1), ("AAA-AND-BBB", "AAA-AND-BBB", 2), ("DEXTROSE 5% INJ", "DEXTROSE 5%", 1), ("SANDOZ", "SANDOZ", 1), ("VITAMIN (NOS) ORAL SPRAY", "VITAMIN", 1), ("ABC\\DEF+GHI", "ABC\\DEF+GHI", 3), ("GEL", "GEL", 1)):
        x = one(spark, drugnames.clean, raw)
        assert (x.cleaned, len(x.components)) == (cleaned, n), raw


def test_rows_and_classes_by_brute_force(spark):
    """Links, pairs and pointers of rows that repeat sets and cases, against all with all."""
    rng = random.Random(7)
    sets = [(["A", "B"], ["U", "V"]), (["A", "B", "C", "D", "E"], ["U", "V"]), (["A", "B", "C", "D"], ["U", "V"]), (["A"], []), (["Z"], ["W"])]
    rows = [(i, rng.choice([None, i // 3, i // 3, i]), "F", 40.0, "US", rng.choice(["2013Q1", "2013Q2"]), rng.choice(["2013-01-01", "2013-02-01"]), *rng.choice(sets)) for i in range(90)]
    df = spark.createDataFrame(rows, "primaryid bigint, caseid bigint, sex string, age_r double, country string, quarter string, fda_dt string, drugs array<string>, reactions array<string>")
    near = lambda a, b: bool(a and b) and 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b})
    pairs = [(x, y) for x, y in itertools.permutations(rows, 2) if x[1] != y[1] and near(x[7], y[7]) and near(x[8], y[8])]
    s = dedup.similar(df)
    want = {x[0]: (sum(a is x for a, _ in pairs), sum(a is x and a[5] != b[5] for a, b in pairs)) for x in rows}
    assert {r.primaryid: (r.links, r.cross_quarter) for r in dedup.link_counts(s).collect()} == want
    f = dedup.pair_figures(s).first()
    assert (f.duplicate_pairs, f.cross_quarter_pairs) == (len(pairs) // 2, sum(a[5] != b[5] for a, b in pairs) // 2) and f.comparisons <= 10
    best = {}
    for x, y in pairs:
        if (y[6], y[0]) > (x[6], x[0]):
            best[x[0]] = max(best.get(x[0], ("", -1)), (y[6], y[0]))
    assert {r.primaryid: r.canonical_primaryid for r in dedup.canonical(s).collect()} == {k: v[1] for k, v in best.items()}


def test_many_equal_reports(spark):
    """100,000 reports with equal sets are one class: no pairs of them are made."""
    df = spark.range(100_000).selectExpr("id as primaryid", "id as caseid", "'F' as sex", "40.0 as age_r", "'US' as country", "'2013Q1' as quarter", "'2013-01-01' as fda_dt", "array('A') as drugs", "array('U') as reactions")
    s = dedup.similar(df)
    f = dedup.pair_figures(s).first()
    assert (f.duplicate_pairs, f.cross_quarter_pairs, f.comparisons) == (100_000 * 99_999 // 2, 0, 0)
    assert dedup.canonical(s).agg(F.count("*"), F.min("canonical_primaryid"), F.max("canonical_primaryid")).first() == (99_999, 99_999, 99_999)


def test_accounting_raises():
    good = {"evaluated": 4, "superseded": 1, "null_key": 0, "empty_drug_set": 1, "eligible": 2, "compared": 2, "alone": 0}
    assert dedup.check_accounting(good) == good
    with pytest.raises(EngineError):
        dedup.check_accounting(good | {"evaluated": 5})


def test_normalization_store(spark, tmp_path):
    kind = "source_field string, folded string, method string, ingredients array<struct<ingredient_rxcui string, ingredient_name string, ingredient_tty string>>"
    make = lambda rows: spark.createDataFrame([("drugname_raw", s, "exact", [(c, n, "IN") for c, n in i]) for s, i in rows], kind)
    root = str(tmp_path)
    with pytest.raises(NormalizationError):
        rxnorm.stored(spark, root)
    first = [("ASPIRIN", [("1", "ASPIRIN")]), ("AB", [("1", "ASPIRIN"), ("2", "CODEINE")])]
    for _ in range(2):  # twice is the same as once
        rxnorm.store(make(first), root)
        assert [t.count() for t in rxnorm.stored(spark, root)] == [2, 3, 2]
    rxnorm.store(make([("AB", [("3", "IBUPROFEN")])]), root)
    match, link, concept = rxnorm.stored(spark, root)
    assert match.count() == 1 and [(r.folded, r.rxcui) for r in link.collect()] == [("AB", "3")] and [r.name for r in concept.collect()] == ["IBUPROFEN"]


def test_former_names_and_adjudication(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, i, 1, DAY, "F", "US", 40.0, "2013Q1") for i in range(200)]
    c, d, r = corpus(spark, rows, {i: rng.sample("ABCDEF", 2) for i in range(200)}, {i: rng.sample("UVWXYZ", 2) for i in range(200)})
    none = spark.createDataFrame([], "primaryid bigint")
    spec = contingency.Spec("raw_string")
    record = signals.build(spark, str(tmp_path), spec, lambda: contingency.build(c, d.withColumn("role_cod", F.lit("PS")), r, none, spec))
    run_id = record["run_id"]
    from medsentry.operators import mgps

    prior = mgps.Prior(1e-6, 0.4, 2.0, 2.0, 0.1, on_boundary=("alpha1",))
    found = signals.diagnose(spark, str(tmp_path), run_id, prior, points=4)
    assert len(found["grid"]) == 4 and found["bound_is_optimum"] == (found["bound_nll"] <= found["argmin_nll"] + 1e-6 * max(1, abs(found["argmin_nll"])))
    held = signals.adjudicated_counts(spark, str(tmp_path), run_id, {"parameter": "alpha1", "bound_is_optimum": False})
    assert held["all_four"] is None and "alpha1" in held["withheld"]
    ruled = signals.adjudicated_counts(spark, str(tmp_path), run_id, {"bound_is_optimum": True})
    df = signals.read_run(spark, str(tmp_path), run_id)
    assert ruled["all_four"] == df.filter("flag_ror_prr_bcpnn and flag_mgps and not insufficient").count() and ruled["withheld"] is None
    df.drop("run_id").withColumnRenamed("flag_ror_prr_bcpnn", "flag_three_of_four").write.parquet(str(tmp_path / "run=20200101T000000Z"))
    assert "flag_ror_prr_bcpnn" in signals.read_run(spark, str(tmp_path), "20200101T000000Z").columns


def archive_of(folder, path):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        for f in folder.rglob("*.*"):
            z.write(f, f.relative_to(folder))
    return str(path)


def test_archives(spark, tmp_path):
    import zipfile

    archive = archive_of(quarter_folder(tmp_path / "in", Quarter(2026, 2)), tmp_path / "a.zip")
    assert files.check_archive(archive, least=10) == files.checksum(archive)
    with pytest.raises(IngestError):
        files.check_archive(archive)  # too small for a whole one
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(IngestError, match="leads out"):
        files.unpacked(spark, tmp_path / "bad.zip", str(tmp_path / "bad"))
    (tmp_path / "no.zip").write_bytes(b"PK is not enough")
    with pytest.raises(IngestError, match="not a complete archive"):
        files.inspected(spark, tmp_path / "no.zip")


def test_unpacked_members_keep_their_bytes(spark, tmp_path):
    """CRLF and LF, CP1252 bytes, no line end at the end, empty members and folders, long members in order."""
    import zipfile

    long = b"\n".join(b"%d$\xe9" % i for i in range(300_000))
    parts = {"ascii/DEMO26Q2.txt": b"a$b\r\n1$\xe9\x80\r\n", "ascii/REAC26Q2.TXT": long, "Deleted/DELETE26Q2.txt": b"\n10\n20", "ascii/EMPTY.txt": b"", "readme.pdf": b"x"}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("ascii")
        for name, content in parts.items():
            z.writestr(name, content)
    size, checksum, members = files.inspected(spark, tmp_path / "a.zip")
    assert (size, checksum) == ((tmp_path / "a.zip").stat().st_size, files.checksum(tmp_path / "a.zip")) and set(members) == set(parts)
    at = files.unpacked(spark, tmp_path / "a.zip", str(tmp_path / "out"))
    read = lambda p: b"".join(f.read_bytes() for f in sorted(Path(p).glob("part-*")))
    assert read(files.find_file(at, "DEMO")) == parts["ascii/DEMO26Q2.txt"] and read(files.find_file(at, "REAC")) == long + b"\n"
    assert {r.caseid for r in files.read_deleted(spark, files.find_deleted(at)).collect()} == {10, 20}
    assert files.encoding_of(files.find_file(at, "REAC")) == "cp1252"


def test_encodings_of_broken_and_cut_sequences(spark, tmp_path):
    """Against Python's own decoders over the whole file, read in few and in many splits."""
    import codecs

    cases = [b"", b"plain\n", "Grün\n語\n😀".encode(), b"\xef\xbb\xbfbom\n", b"caf\xe9\n", b"cut \xc3\nnext\n", b"cut at the end \xe8\xaa", b"\xc0\xaf overlong", b"\xed\xa0\x80 surrogate", b"\xf4\x90\x80\x80 beyond", b"hole \x81", b"ok\r\n\x9d\r\n", "é".encode() * 50_000 + b"\n" + b"a" * 50_000 + b"\xe9"]
    for k, content in enumerate(cases):
        at = tmp_path / f"{k}.txt"
        at.write_bytes(content)

        def decodes(name, content=content):
            try:
                codecs.decode(content, name)
                return True
            except UnicodeDecodeError:
                return False

        want = next((n for n in files.ENCODINGS if decodes(n)), None) if not content.startswith(codecs.BOM_UTF8) else "ascii"
        if want:
            assert files.encoding_of(at) == want, content[:20]
        else:
            with pytest.raises(IngestError):
                files.encoding_of(at)


def test_command_line(spark, tmp_path, capsys):
    from medsentry import __version__, cli

    q, root = Quarter(2026, 2), str(tmp_path / "root")
    archive = archive_of(quarter_folder(tmp_path / "in", q), tmp_path / "a.zip")

    def call(*args):
        code = cli.main(["--root", root, *args], spark)
        return code, capsys.readouterr().out

    assert call("version") == (0, f"{__version__}\n")
    code, out = call("ingest", archive, "2026Q2")
    assert code == 0 and json.loads(out)["rows"]["case"] == 1
    assert json.loads(call("ingest", archive, "2026Q2")[1]) == {"skipped": "2026Q2"}
    assert json.loads(call("status")[1])["2026Q2"]["status"] == "completed"
    code, out = call("dedup")
    assert code == 0 and json.loads(out)["population"]["evaluated"] == 1 and json.loads(out)["pairs"]["comparisons"] == 0
    code, out = call("quality", "--out", str(tmp_path / "q.json"))
    assert code == 0 and "comparisons: not measured" in out and json.loads((tmp_path / "q.json").read_text())["rates"]["stage1"]["flagged"] == 0
    assert call("build")[0] == 1  # no normalization tables
    code, out = call("build", "--drug-key", "raw_string", "--roles", "ps", "--adjudicated")
    assert code == 0 and json.loads(out)["pairs_written"] == 1
    assert call("artifact", "--out", str(tmp_path / "h.json"))[0] == 0 and len(json.loads((tmp_path / "h.json").read_text())["runs"]) == 1
    store.delete_quarter(spark, f"{root}/corpus", "drug", "2026Q2")
    assert not (tmp_path / "root/corpus/drug/quarter=2026Q2").exists() and (tmp_path / "root/corpus/case/quarter=2026Q2").exists()


def test_a_quarter_like_the_published_slice(spark, tmp_path):
    """A hand-made quarter with the counts of the 2013Q1 slice: units, sexes, lengths of dates and outcomes; CRLF, and a list of withdrawn cases."""
    q, root = Quarter(2013, 1), str(tmp_path / "out")
    spread = lambda counts: [v for v, n in counts for _ in range(n)]
    units = spread([("YR", 75), ("", 24), ("DY", 4), ("HR", 4), ("MON", 4), ("DEC", 4), ("WK", 4), ("MIN", 1)])
    weights = spread([("KG", 46), ("LBS", 3), ("GMS", 1), ("YEARS", 1), ("", 69)])
    sexes = spread([("F", 68), ("M", 43), ("NS", 6), ("UNK", 3)])
    dates = spread([("20130115", 60), ("", 29), ("201301", 18), ("2013", 13)])
    codes = spread([("DE", 21), ("HO", 59), ("OT", 75), ("LT", 12), ("DS", 7), ("CA", 13), ("RI", 3)])
    demo = [{"primaryid": f"{1000 + k}1", "caseid": str(1000 + k), "caseversion": "1", "fda_dt": "20130131", "event_dt": dates[k], "age": "5" if units[k] else "", "age_cod": units[k], "gndr_cod": sexes[k], "wt": "70" if weights[k] else "", "wt_cod": weights[k], "occr_country": "US"} for k in range(120)]
    outc = [{"primaryid": f"{1000 + k % 110}1", "caseid": str(1000 + k % 110), "outc_cod": c} for k, c in enumerate(codes)]
    at = tmp_path / "in" / "ascii"
    at.mkdir(parents=True)
    for table, rows in (("DEMO", demo), ("OUTC", outc)):
        names = [f.source for f in schema.source_fields(table, q)]
        (at / f"{table}13Q1.txt").write_bytes("\r\n".join(["$".join(names), *("$".join(r.get(n, "") for n in names) for r in rows), ""]).encode())
    (tmp_path / "in" / "Deleted").mkdir()
    (tmp_path / "in" / "Deleted" / "DELETE13Q1.txt").write_text(" \n1000\n1001\n999999\n")
    report = ingest.ingest_quarter(spark, tmp_path / "in", root, q, ("DEMO", "OUTC"))
    tally = report["tallies"]["DEMO"]
    assert (tally["rows"], tally["weight_implausible_unit"], tally["sex_missing"], tally["age_missing_or_unconvertible"]) == (120, 1, 0, 0)
    assert report["date_precision"] == {"day": 58, "missing": 29, "month": 18, "year": 13} and report["had_deleted_file"]
    case = store.read_dataset(spark, root, "case")
    assert case.count() == report["rows"]["case"] == 118 and case.filter("serious").count() == 108
    kept = {r["primaryid"] for r in demo[2:]}
    assert report["rows"]["outcome"] == sum(r["primaryid"] in kept for r in outc)
    assert case.filter("serious_death").count() == 19 and case.filter("age_years is not null").count() == 94
