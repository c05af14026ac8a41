"""Command line: ``python -m medsentry.cli --root FOLDER COMMAND``.

The root holds ``corpus`` (datasets by quarter), ``duplicate``, ``normalization``, ``runs`` and the manifest.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import __version__
from .errors import EngineError, IngestError
from .operators import contingency, dedup, mgps, rxnorm
from .plans import ingest, quality, signals
from .sources import links, store, web
from .sources.quarter import Quarter


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="medsentry")
    parser.add_argument("--root", default="data", help="folder of the corpus and its results")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    p = commands.add_parser("discover", help="the archives that a page links to, by quarter")
    p.add_argument("page", help="the page's url")
    p = commands.add_parser("ingest", help="ingest the archive of a quarter")
    p.add_argument("archive", help="a zip file or its url")
    p.add_argument("quarter", help="for example 2012Q4")
    p.add_argument("--force", action="store_true", help="also if it was ingested unchanged")
    p = commands.add_parser("status", help="the quarters that are ingested")
    for name, what in (("dedup", "find duplicates over the corpus"), ("quality", "the quality report of the stored corpus")):
        p = commands.add_parser(name, help=what)
        p.add_argument("--from", dest="start", help="first quarter")
        p.add_argument("--to", dest="end", help="last quarter")
    p.add_argument("--out", help="JSON file of the report")
    p = commands.add_parser("build", help="score all pairs as a new run")
    p.add_argument("--drug-key", choices=contingency.KEYS, default="ingredient")
    p.add_argument("--roles", choices=sorted(contingency.ROLES), default="ps_ss")
    p.add_argument("--min-a", type=int, default=3, help="reports below which a pair is flagged as insufficient")
    p.add_argument("--from", dest="start")
    p.add_argument("--to", dest="end")
    p.add_argument("--adjudicated", action="store_true", help="report the conjunction although the prior lies on a bound")
    p = commands.add_parser("diagnostic", help="profile a parameter of a run's prior from its bound")
    p.add_argument("--run", help="the latest if not given")
    p.add_argument("--parameter", choices=mgps.NAMES, default="alpha1")
    p.add_argument("--points", type=int, default=19)
    p.add_argument("--out", required=True)
    p = commands.add_parser("artifact", help="the history of all runs")
    p.add_argument("--out", required=True)
    p.add_argument("--diagnostic", help="JSON file of a diagnostic that may adjudicate the conjunction")
    return parser


def _archives(spark: SparkSession, page: str) -> dict[str, str]:
    answer = web.Client().get(page)
    if answer.status != 200:
        raise IngestError(f"{page}: status {answer.status}")
    rows = spark.createDataFrame([(page, answer.body.decode("utf-8", "replace"))], "url string, html string")
    return {r.quarter: r.link for r in links.archives(rows).collect()}


def run(args: argparse.Namespace, spark: SparkSession) -> dict | list | str:
    root, corpus, runs = args.root, f"{args.root}/corpus", f"{args.root}/runs"
    manifest = store.Manifest(f"{root}/manifest.json")
    read = lambda name: store.read_dataset(spark, corpus, name)
    if args.command == "discover":
        return links.cached(Path(root, "archives.json"), lambda: _archives(spark, args.page))
    if args.command == "ingest":
        if args.archive.startswith(("http://", "https://")):
            at = Path(root, "raw", f"{Quarter.parse(args.quarter).label}.zip")
            web.download(args.archive, at)
            args.archive = str(at)
        return ingest.ingest_archive(spark, args.archive, corpus, Quarter.parse(args.quarter), manifest, args.force) or {"skipped": args.quarter}
    if args.command == "status":
        return {u: {"status": r["status"], "row_count": r["row_count"], "error": r["error"]} for u, r in sorted(manifest.rows.items())}
    if args.command == "dedup":
        every, figures = ingest.duplicates(read("case"), read("drug"), read("reaction"), args.start, args.end)
        chain = ingest.persist(every, f"{root}/duplicate")
        out = {k: df.first().asDict() for k, df in figures.items()}
        dedup.check_accounting(out["population"])
        store.save_json(f"{root}/dedup.json", out | {"chains": chain})
        return out | {"chains": chain}
    if args.command == "quality":
        every = spark.read.parquet(f"{root}/duplicate")
        own = ingest.figures_from_store(read("case"), read("drug"), read("reaction"), every, args.start, args.end)
        report = quality.build(ingest.from_manifest(manifest, args.start, args.end), own, own["flagged_by_method"], figures=own)
        if args.out:
            quality.write(report, args.out)
        return quality.render(report)
    if args.command == "build":
        spec = contingency.Spec(args.drug_key, args.roles, args.min_a, args.start, args.end)
        every = spark.read.parquet(f"{root}/duplicate")
        names = rxnorm.stored(spark, f"{root}/normalization") if args.drug_key == "ingredient" else None
        return signals.build(spark, runs, spec, lambda: contingency.build(read("case"), read("drug"), read("reaction"), every, spec, names), args.adjudicated, {"quarters": manifest.completed()})
    if args.command == "diagnostic":
        run_id = args.run or signals.latest_run(runs)
        prior = mgps.Prior(**{k: signals.read_record(runs, run_id)["prior"][k] for k in mgps.NAMES})
        out = signals.diagnose(spark, runs, run_id, prior, args.parameter, args.points)
        store.save_json(args.out, out)
        return out
    return signals.history(runs, args.out, store.load_json(args.diagnostic) if args.diagnostic else None, spark)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "version":
            out = __version__
        else:
            out = run(args, spark or SparkSession.builder.appName("medsentry").getOrCreate())
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(out, indent=1, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
