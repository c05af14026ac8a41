"""Ingest of one quarter and the duplicate pass over the stored corpus."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains, dedup, parse
from ..sources import files, store
from ..sources.quarter import Quarter
from ..sources.schema import TABLE_OF
from ..storage import delete, discard, shared_dir, written


def ingest_quarter(spark: SparkSession, folder: str | Path, root: str, quarter: Quarter, tables: tuple[str, ...] | None = None) -> dict:
    """Read, parse, reduce to surviving cases and write the seven datasets of an extracted quarter.

    Seriousness is attached before versions are resolved; the tallies cover every parsed row, the
    date precisions the survivors. ``tables`` limits the work to source tables that are there. The text of
    an extract is split into fields once and kept in columns; units, tallies and datasets read those they need.
    """
    raw = {t: written(files.read_table(spark, files.find_file(folder, t), t, quarter), f"raw-{t.lower()}") for t in (tables or tuple(sorted({*TABLE_OF.values()})))}
    withdrawn_at = files.find_deleted(folder)
    parse.check_age_units(raw["DEMO"])
    tallies = {t: parse.tally(df, t).first().asDict() for t, df in raw.items() if parse.conditions(t)}
    parsed = {t: parse.PARSERS[t](df) for t, df in raw.items()}
    cases = parsed["DEMO"]
    if "OUTC" in parsed:
        cases = parse.attach_seriousness(cases, parsed["OUTC"])
    kept = written(parse.latest_versions(cases.withColumn("quarter", F.lit(quarter.label)), files.read_deleted(spark, withdrawn_at)), "cases")
    rows = {}
    for name, table in TABLE_OF.items():
        if table in parsed:
            own = kept if name == "case" else parse.surviving(parsed[table], kept)
            out = parse.dataset(own, name)
            store.write_quarter(out, root, name, quarter.label)
            rows[name] = store.read_dataset(spark, root, name).filter(F.col("quarter") == quarter.label).count()
    precision = {r.value: r.n for r in kept.groupBy(F.col("event_dt_precision").alias("value")).agg(F.count("*").alias("n")).collect()}
    discard(kept, *raw.values())
    return {"quarter": quarter.label, "rows": rows, "tallies": tallies, "date_precision": precision, "had_deleted_file": withdrawn_at is not None}


def ingest_archive(spark: SparkSession, archive: str, root: str, quarter: Quarter, manifest: store.Manifest, force: bool = False) -> dict | None:
    """Ingest a zip archive under the manifest: skipped (None) if it is done and unchanged, recorded if it fails."""
    size, checksum, _ = files.inspected(spark, archive)
    if not manifest.should_ingest(quarter.label, checksum, force):
        return None
    manifest.start(quarter.label, checksum, size=size)
    at = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    try:
        report = ingest_quarter(spark, files.unpacked(spark, archive, at), root, quarter)
    except Exception as e:
        manifest.fail(quarter.label, str(e)[:500])
        raise
    finally:
        delete(at)
    manifest.complete(quarter.label, report["rows"], report["had_deleted_file"])
    return report


def duplicates(cases: DataFrame, drugs: DataFrame, reactions: DataFrame, start: str | None = None, end: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(all duplicates, figures) of the corpus: versions over every quarter, re-reports within the range."""
    latest = dedup.needed(dedup.latest_publication(cases))
    versions = written(dedup.superseded_versions(latest), "versions")
    p = dedup.population(dedup.latest_publication(cases, start, end), drugs, reactions) if start or end else dedup.population(latest, drugs, reactions, versions)
    s = dedup.similar(p.compared)
    found = dedup.canonical(s)
    figures = {"population": dedup.accounting(p), "blocks": dedup.block_figures(p), "pairs": dedup.pair_figures(s), "discarded": dedup.discarded(versions, found)}
    return dedup.combined(versions, found), figures


def persist(every: DataFrame, path: str) -> dict:
    """Rebuild the duplicate table as a whole and verify where its pointers lead."""
    store.write_whole(every, path)
    edges = every.sparkSession.read.parquet(path)
    return chains.report(chains.resolve(edges), edges).first().asDict()


def figures_from_store(cases: DataFrame, drugs: DataFrame, reactions: DataFrame, every: DataFrame, start: str | None = None, end: str | None = None) -> dict:
    """What the stored corpus and duplicate table still tell of a pass.

    The population is classified anew by the same function that the pass uses. Figures that only the pass
    itself had are None: they are not measured, which isn't zero.
    """
    p = dedup.population(dedup.latest_publication(cases, start, end), drugs, reactions)
    own = dedup.check_accounting(dedup.accounting(p).first().asDict())
    methods = {r.method: r for r in dedup.method_figures(every).collect()}
    count = lambda method, what: methods[method][what] if method in methods else 0
    flagged = {m: count(m, "flagged") for m in (dedup.VERSION, dedup.SIMILAR)}
    missing = dict.fromkeys(("blocks", "largest_block", "naive_pairs", "comparisons"))
    return own | {"flagged": every.select("primaryid").distinct().count(), "flagged_by_method": flagged, "cross_quarter": count(dedup.SIMILAR, "cross_quarter"), "from_store": True} | missing


def from_manifest(manifest: store.Manifest, start: str | None = None, end: str | None = None) -> list[dict]:
    """The ingest results that the manifest recorded, for reports on the corpus as it is stored."""
    rows = ((u, manifest.rows[u]) for u in manifest.completed(start, end))
    return [{"quarter": u, "rows": r["row_counts"], "tallies": {}, "date_precision": {}, "had_deleted_file": r["had_deleted_file"], "bytes_downloaded": r["bytes_downloaded"]} for u, r in rows]
