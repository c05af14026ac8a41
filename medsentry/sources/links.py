"""Links to quarterly archives in HTML pages."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IngestError

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
ARCHIVE = r"(?i)faers_ascii_(\d{4})q([1-4])\.zip"
FRESH_S = 7 * 24 * 3600


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row a link, in order, with the page's other columns."""
    return pages.withColumn("_links", F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))).select(*(c for c in pages.columns if c != html), F.posexplode("_links").alias("pos", "href"))


def absolute(base: str, href: str):
    """An href against its page's url."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<![:/])/[^/]*$", "")
    h = F.col(href)
    return F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat(folder, F.lit("/"), h))


def archives(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(quarter, link): the first link of each quarter's archive."""
    links = anchors(pages, html).filter(F.col("href").rlike(ARCHIVE))
    quarter = F.concat(F.regexp_extract("href", ARCHIVE, 1), F.lit("Q"), F.regexp_extract("href", ARCHIVE, 2))
    return links.groupBy(quarter.alias("quarter")).agg(F.min_by(absolute(url, "href"), F.struct(url, "pos")).alias("link"))


def cached(path: str | Path, fetch) -> dict[str, str]:
    """Quarter -> link from a JSON cache of up to seven days; ``fetch()`` fills it. No links raise."""
    path = Path(path)
    try:
        if time.time() - path.stat().st_mtime < FRESH_S and (held := json.loads(path.read_text())):
            return held
    except (OSError, ValueError):
        pass  # no cache, or one that can't be read, is filled anew
    links = fetch()
    if not links:
        raise IngestError("the page has no archive links")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(links, sort_keys=True))
    return links


def latest(links: dict[str, str]) -> str:
    return max(links)
