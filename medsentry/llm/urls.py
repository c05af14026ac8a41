"""URL filtering with pattern rules that are indexed by their rarest literal token.

A rule's literal tokens are those that any URL it fits must have as whole tokens. The token that
the fewest URLs of the table have becomes the rule's key; a URL's tokens fetch the rules under
them, and only these run their regular expressions. Rules without such a token run on every URL.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path. A listed rule (host and path prefix) has a name; the
    longest listed rule decides. Other rules block, or allow, what no listed rule fits."""

    name: str | None
    pattern: str
    tokens: tuple[str, ...]
    action: str


def listed_rule(action: str, host: str, path: str) -> Rule:
    """A rule for a host with all its subdomains and paths that start with ``path``."""
    ended = path if path.endswith("/") else path[: len(path) - len(re.search(r"[A-Za-z0-9]*\Z", path)[0])]
    # Only lower-case path tokens are literal: the index folds case, the pattern doesn't.
    stop = "" if path else r"(?:/|\Z)"
    return Rule(host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}{stop}", tuple(_TOKEN.findall(host + " " + ended.translate(_UPPER))), action)


def word_rule(action: str, word: str) -> Rule:
    """A rule for hosts that have ``word`` as a whole token."""
    return Rule(None, rf"^(?:[^/]*[.-])?{re.escape(word)}[.-]", (word,), action)


def path_rule(action: str, name: str) -> Rule:
    """A rule for paths that have ``name`` as a whole part."""
    return Rule(None, rf"^[^/]*/(?:[^/]*/)*{re.escape(name)}(?:/|\Z)", tuple(_TOKEN.findall(name.translate(_UPPER))), action)


def pair_rule(action: str, first: str, second: str) -> Rule:
    """A rule for hosts that have the two words beside each other, joined by a dash or nothing between parts of a name."""
    return Rule(None, rf"^(?:[^/]*[.-])?{re.escape(first)}-{re.escape(second)}[.-]", (first, second), action)


#: The listed rules, which are fixed.
LISTED = (
    listed_rule("allow", "com", "/"),
    listed_rule("block", "example.com", "/en/"),
    listed_rule("allow", "www.example.com", "/en/"),
    listed_rule("block", "net", "/es/"),
    listed_rule("block", "net", "/fr/"),
)
#: What decides where no listed rule fits: hosts that sell, bet or track; paths of advertising, log-ins and machine pages.
HOST_WORDS = ("casino", "pills", "bets", "spam", "ads", "porn", "viagra", "malware", "phishing", "warez", "xxx", "torrent", "torrents", "poker", "slots", "lottery", "payday", "adserver", "doubleclick", "tracker")
HOST_PAIRS = (("free", "download"), ("cheap", "meds"), ("click", "here"), ("win", "prize"), ("url", "shortener"), ("adult", "chat"))
PATH_PARTS = ("adserver", "affiliate", "banner", "popup", "cgi-bin", "wp-login.php", "xmlrpc.php", "phpmyadmin", "wp-admin", "sponsored", "unsubscribe", "tracking-pixel")
WORDS = (*(word_rule("block", w) for w in HOST_WORDS), *(pair_rule("block", *w) for w in HOST_PAIRS), *(path_rule("block", w) for w in PATH_PARTS))


def parts(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for null and where there is no ``://``."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(host + " " + path.translate(_UPPER)))


class Index:
    """Rules by their rarest token. ``seen`` is the number of URLs that have each token."""

    def __init__(self, rules: tuple[Rule, ...], seen: dict[str, int]):
        self.by, self.always = defaultdict(list), []
        for r in rules:
            entry = (r, re.compile(r.pattern))
            if r.tokens:
                self.by[min(r.tokens, key=lambda t: (seen.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def candidates(self, host: str, path: str) -> Iterator[tuple[Rule, re.Pattern]]:
        yield from self.always
        for t in tokens(host, path):
            yield from self.by.get(t, ())

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        whole = host + path
        return decided(rule for rule, pattern in self.candidates(host, path) if pattern.search(whole))


def decided(fitting: Iterable[Rule]) -> tuple[str | None, str]:
    """The name of the longest listed rule and its action, or none and what the others say; block is stronger, also of two listed rules of one name."""
    best, verdict = None, "allow"
    for rule in fitting:
        if rule.name is None:
            verdict = "block" if "block" in (verdict, rule.action) else verdict
        elif best is None or (len(rule.name), rule.name, rule.action) > (len(best.name), best.name, best.action):
            best = rule
    return (best.name, best.action) if best else (None, verdict)


def token_counts(pages: DataFrame, wanted: set[str], url_col: str = "url") -> DataFrame:
    """(token, n): how many URLs have each wanted token; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                count.update(tokens(*parts(url)) & wanted)
        yield pa.record_batch({"token": pa.array(count.keys(), pa.string()), "n": pa.array(count.values(), pa.int64())})

    return pages.select(F.col(url_col).alias("url")).mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + WORDS, id_col: str = "page_id", url_col: str = "url", in_memory: int = 200_000, block: int = 10_000) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``.

    Up to ``in_memory`` rules each worker holds the index and no row is shuffled. Beyond that the
    index is a table: the distinct hosts and paths are joined with it by token and the fitting
    rules reduced to one for each; rules without a literal token run on every distinct host and path, in
    blocks of ``block`` of them. Both ways run the same regular expressions. Cases: null and malformed URLs have empty host and path, fit no rule
    and are allowed; of listed rules that are equally long the later name wins, and of equal names block; long URLs are read whole; without rules all are allowed; repeated rows each give
    a row; other columns are not read.
    """
    wanted = {t for r in rules for t in r.tokens}
    rows = pages.selectExpr(f"cast(`{id_col}` as bigint) page_id", f"`{url_col}` url")
    if len(rules) > in_memory:
        return _joined(rows, rules, block)
    seen = {r.token: r.n for r in token_counts(rows, wanted).collect()}  # a row for each token of the rules at most

    def make():
        index = Index(rules, seen)

        def each(batch):
            split = [parts(u) for u in batch.column(1).to_pylist()]
            verdicts = [index.judge(*p) for p in split]
            yield {"page_id": batch.column(0).to_pylist(), "host": [h for h, _ in split], "path": [p for _, p in split], "rule": [r for r, _ in verdicts], "verdict": [v for _, v in verdicts]}

        return each

    schema = pa.schema([("page_id", pa.int64()), *((k, pa.string()) for k in ("host", "path", "rule", "verdict"))])
    return map_batches(rows, make, schema, "page_id bigint, host string, path string, rule string, verdict string")


@lru_cache(maxsize=100_000)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def _joined(rows: DataFrame, rules: tuple[Rule, ...], block: int) -> DataFrame:
    """The same with the rules as a table."""
    spark = rows.sparkSession
    page = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string())])
    word = pa.schema([("host", pa.string()), ("path", pa.string()), ("token", pa.string())])
    fit = pa.schema([("host", pa.string()), ("path", pa.string()), ("name", pa.string()), ("action", pa.string())])

    def split(batch):
        found = [parts(u) for u in batch.column(1).to_pylist()]
        yield {"page_id": batch.column(0).to_pylist(), "host": [h for h, _ in found], "path": [p for _, p in found]}

    def spread(batch):
        for at in range(0, batch.num_rows, 1024):
            found = [(h, p, t) for h, p in zip(*(batch.column(k).slice(at, 1024).to_pylist() for k in (0, 1)), strict=True) for t in sorted(tokens(h, p))]
            yield dict(zip(("host", "path", "token"), map(list, zip(*found, strict=True)) if found else ([], [], []), strict=True))

    def fitting(batch):
        found = [(h, p, n, a) for h, p, n, x, a in zip(*(c.to_pylist() for c in batch.columns), strict=True) if _compiled(x).search(h + p)]
        yield dict(zip(fit.names, map(list, zip(*found, strict=True)) if found else ([], [], [], []), strict=True))

    def best(fits: DataFrame) -> DataFrame:
        return fits.groupBy("host", "path").agg(F.max(F.when(F.col("name").isNotNull(), F.struct(F.length("name").alias("n"), "name", "action"))).alias("b"), F.max(F.when(F.col("name").isNull(), F.col("action"))).alias("other"))

    cut = stored(map_batches(rows, lambda: split, page, "page_id bigint, host string, path string"), "pages")
    distinct = stored(cut.select("host", "path").distinct(), "urls")
    asked = map_batches(distinct, lambda: spread, word, "host string, path string, token string")
    table = spark.createDataFrame([(i, r.name, r.pattern, list(r.tokens), r.action) for i, r in enumerate(rules) if r.tokens], "id bigint, name string, pattern string, tokens array<string>, action string")
    count = asked.groupBy("token").agg(F.count("*").alias("n"))
    keyed = table.select("id", "name", "pattern", "action", F.explode("tokens").alias("token")).join(count, "token", "left")
    index = keyed.groupBy("id", "name", "pattern", "action").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    found = asked.join(index, "token").select("host", "path", "name", "pattern", "action")
    fits = map_batches(found, lambda: fitting, fit, "host string, path string, name string, action string")

    def always(sent):
        def make():
            index = Index(tuple(sent.value), {})

            def run(batch):
                found = []
                for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    name, verdict = index.judge(h, p)
                    if name or verdict != "allow":
                        found.append((h, p, name, verdict))
                yield dict(zip(fit.names, map(list, zip(*found, strict=True)) if found else ([], [], [], []), strict=True))

            return run

        return make

    free = [r for r in rules if not r.tokens]
    for at in range(0, len(free), block):
        sent = spark.sparkContext.broadcast(free[at : at + block])
        fits = fits.unionByName(map_batches(distinct, always(sent), fit, "host string, path string, name string, action string"))
    return cut.join(best(fits), ["host", "path"], "left").select("page_id", "host", "path", F.col("b.name").alias("rule"), F.coalesce("b.action", "other", F.lit("allow")).alias("verdict"))
