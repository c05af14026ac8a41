"""The quality report: roll-ups of ingest reports, duplicate rates with their own denominators, and their text form."""

from __future__ import annotations

from collections import Counter

from ..sources.store import save_json


def _share(part: int | None, whole: int | None) -> float | None:
    if part is None or whole is None:
        return None
    return round(part / whole, 6) if whole else 0.0


def rates(population: dict | None, flagged: dict[str, int]) -> dict:
    """Each rule's rate over the records it was applied to; a figure that wasn't measured is null, not zero."""
    p = population or {}
    version, similar = flagged.get("version"), flagged.get("probabilistic")
    every = None if version is None or similar is None else version + similar
    cases = p.get("evaluated")
    return {
        "stage1": {"flagged": version, "of": cases, "rate": _share(version, cases)},
        "stage2": {"flagged": similar, "of": p.get("eligible"), "rate": _share(similar, p.get("eligible"))},
        "overall": {"flagged": every, "of": cases, "rate": _share(every, cases)},
        "unique_cases": None if every is None or cases is None else cases - every,
    }


def build(ingested: list[dict], population: dict | None, flagged: dict[str, int], chain: dict | None = None, figures: dict | None = None) -> dict:
    rows, tallies, precision = Counter(), Counter(), Counter()
    for report in ingested:
        rows.update(report["rows"])
        precision.update(report["date_precision"])
        for table, own in report["tallies"].items():
            tallies.update({f"{table.lower()}.{k}": v for k, v in own.items()})
    return {"quarters": sorted(r["quarter"] for r in ingested), "rows": dict(rows), "nulls": dict(tallies), "date_precision": dict(precision), "population": population, "rates": rates(population, flagged), "chain": chain, "pass": figures, "deleted_lists": {r["quarter"]: r["had_deleted_file"] for r in ingested}}


def write(report: dict, path) -> None:
    save_json(path, report)


def render(report: dict) -> str:
    """The report as indented lines, keys sorted."""

    def lines(value, depth: int) -> list[str]:
        out = []
        for k in sorted(value):
            v = value[k]
            out += [f"{'  ' * depth}{k}:", *lines(v, depth + 1)] if isinstance(v, dict) else [f"{'  ' * depth}{k}: {'not measured' if v is None else v}"]
        return out

    return "\n".join(lines(report, 0))
