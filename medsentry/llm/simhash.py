"""SimHash near-duplicates, found exactly with a vantage-point tree.

The distinct fingerprints are partitioned by Hamming distance to vantage points. Each has one
home shard; one that lies beyond a boundary by no more than the radius also goes to the other
side as a query, which the triangle inequality shows to be enough. Within a shard a tree of the
same kind prunes the comparison, and only a spanning forest of its links leaves the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored
from .components import components

#: Home fingerprints that a shard should have, members of a task's grid cell at most, and
#: fingerprints from which the shards' vantage points are chosen: POINTS for each shard, SAMPLE at most.
SHARD, CELL, POINTS, SAMPLE = 32_768, 65_536, 32, 1 << 20


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """64 bits, one set where over half the shingles' XXH64 have it; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    hashed, digest, n = np.zeros(64, np.int64), xxhash.xxh64_intdigest, len(words) - size + 1
    for at in range(0, n, 16384):
        until = min(at + 16384, n)
        h = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts[at:until], ends[at + size - 1 : until + size - 1], strict=True)], "<u8")
        hashed += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(hashed * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, fp): a hash and the fingerprint of each whole text as signed 64-bit integers."""

    def make():
        def each(batch):
            fps = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column(1)], np.uint64)
            yield {"doc_id": batch.column(0).to_pylist(), "mark": batch.column(2).to_pylist(), "fp": fps.view(np.int64)}

        return each

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), _mark(text_col).alias("mark"))
    return map_batches(rows, make, pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("fp", pa.int64())]), "doc_id bigint, mark bigint, fp bigint")


def _mark(text_col: str) -> Column:
    """A hash that tells texts apart whose rows have the same id."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def vantage_tree(sample: np.ndarray, depth: int, seed: int = 7) -> list[tuple[int, int]]:
    """(vantage point, median distance) of each inner node of a complete tree, in breadth-first order."""
    rng, nodes, level = np.random.default_rng(seed), [], [sample]
    for _ in range(depth):
        below = []
        for part in level:
            vp = np.uint64(rng.choice(part)) if len(part) else np.uint64(0)
            d = np.bitwise_count(part ^ vp)
            mu = int(np.median(d)) if len(part) else 32
            nodes.append((int(vp), mu))
            below += [part[d <= mu], part[d > mu]]
        level = below
    return nodes


def route(fps: np.ndarray, nodes: list[tuple[int, int]], depth: int, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices, home) for the fingerprints that each shard gets."""
    live = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    for _ in range(depth):
        below = []
        for node, rows, home in live:
            vp, mu = nodes[node]
            d = np.bitwise_count(fps[rows] ^ np.uint64(vp)).astype(np.int64)
            # A home row on the right also asks on the left; a visitor asks on either side it can have links.
            left = np.where(home, d <= mu + radius, d <= mu + radius)
            right = np.where(home, d > mu, d > mu - radius)
            below.append((2 * node + 1, rows[left], home[left] & (d[left] <= mu)))
            below.append((2 * node + 2, rows[right], home[right]))
        live = [x for x in below if len(x[1])]
    return [(node - ((1 << depth) - 1), rows, home) for node, rows, home in live]


class _Forest:
    """Labels of the rows of one task; links are merged in large lots."""

    def __init__(self, n: int):
        self.label, self.lots, self.held = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.label[a] != self.label[b]
        if new.any():
            self.lots.append((a[new], b[new]))
            self.held += int(new.sum())
            if self.held > 200_000:
                self.merge()

    def merge(self) -> None:
        if not self.lots:
            return
        a, b = (np.concatenate(x) for x in zip(*self.lots, strict=True))
        self.lots, self.held = [], 0
        parent = np.arange(len(self.label))
        while True:
            pa_, pb = parent[self.label[a]], parent[self.label[b]]
            open_ = pa_ != pb
            if not open_.any():
                break
            np.minimum.at(parent, np.maximum(pa_, pb)[open_], np.minimum(pa_, pb)[open_])
            while (nxt := parent[parent]).tobytes() != parent.tobytes():
                parent = nxt
        self.label = parent[self.label]


def link(fps: np.ndarray, home: np.ndarray, asks: np.ndarray, radius: int, small: int = 4096) -> np.ndarray:
    """For each fingerprint the index of its tree's root, where asks[i] and home[j] within ``radius`` are linked."""
    forest, rng = _Forest(len(fps)), np.random.default_rng(3)

    def compare(h: np.ndarray, q: np.ndarray) -> None:
        for i in range(0, len(q), 128):
            x = fps[q[i : i + 128], None]
            for j in range(0, len(h), 2048):
                r, c = np.nonzero(np.bitwise_count(x ^ fps[None, h[j : j + 2048]]) <= radius)
                a, b = q[i + r], h[j + c]
                if len(a) and (keep := a != b).any():
                    forest.add(a[keep], b[keep])

    stack = [(home, asks, 0)]
    while stack:
        h, q, level = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) <= small or level > 24:
            compare(h, q)
            continue
        vp = fps[rng.choice(h)]
        dh, dq = (np.bitwise_count(fps[x] ^ vp).astype(np.int64) for x in (h, q))
        mu = int(np.median(dh))
        hl, ql, qr = dh <= mu, dq <= mu + radius, dq > mu - radius
        if hl.all() or ql.sum() * hl.sum() + qr.sum() * (~hl).sum() > 0.98 * len(h) * len(q):  # nothing to prune
            compare(h, q)
            continue
        stack += [(h[hl], q[ql], level + 1), (h[~hl], q[qr], level + 1)]
    forest.merge()
    return forest.label


def linked(distinct: DataFrame, radius: int = 4, shard: int = SHARD, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(u, v): a spanning forest of the links between the distinct values of column ``fp``.

    The vantage points come from a bounded sample (POINTS values of least hash for each shard, ``sample``
    at most); they only steer the partitioning and the result doesn't depend on them. The tree is as deep
    as the sample can steer, so beyond SAMPLE / POINTS shards these become larger. A shard with more members
    than ``cell`` is dealt out as a grid of home blocks against query blocks, so no task holds
    more than two blocks.
    """
    n = distinct.count()
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / shard)))), int(np.log2(max(1, sample / POINTS)))))
    picked = distinct.select("fp", F.xxhash64("fp").alias("h")).orderBy("h", "fp").limit(POINTS << depth).collect() if depth else []
    nodes = vantage_tree(np.array([r.fp for r in picked], np.int64).view(np.uint64), depth)

    def make():
        def each(batch):
            fps = batch.column(0).to_numpy().view(np.uint64)
            for s, rows, home in route(fps, nodes, depth, radius):
                yield {"shard": np.full(len(rows), s, np.int32), "fp": fps[rows].view(np.int64), "home": home}

        return each

    members = map_batches(distinct.select("fp"), make, pa.schema([("shard", pa.int32()), ("fp", pa.int64()), ("home", pa.bool_())]), "shard int, fp bigint, home boolean")
    sizes = members.groupBy("shard").agg(F.count_if("home").alias("nh"), F.count("*").alias("nq")).collect()  # one row a shard
    grid = {r.shard: (-(-r.nh // cell) or 1, -(-r.nq // cell)) for r in sizes}
    if not grid:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    plan = distinct.sparkSession.createDataFrame([(s, int(a), int(b)) for s, (a, b) in grid.items()], "shard int, gh int, gq int")
    spread = members.join(F.broadcast(plan), "shard")  # a row for each shard, of which there are n / SHARD at most doubled
    salt = F.xxhash64(F.col("fp"), F.lit(11))
    as_home = spread.filter("home").select("shard", "fp", F.lit(True).alias("home"), F.pmod(salt, "gh").cast("int").alias("i"), F.explode(F.expr("sequence(0, gq - 1)")).alias("j"))
    as_query = spread.select("shard", "fp", F.lit(False).alias("home"), F.explode(F.expr("sequence(0, gh - 1)")).alias("i"), F.pmod(salt, "gq").cast("int").alias("j"))

    def work(table: pa.Table) -> pa.Table:
        fps, which = np.unique(table.column("fp").to_numpy(), return_inverse=True)
        home = table.column("home").to_numpy()
        root = link(fps.view(np.uint64), np.unique(which[home]), np.unique(which[~home]), radius)
        moved = root != np.arange(len(fps))
        return pa.table({"u": fps[moved], "v": fps[root[moved]]})

    return as_home.unionByName(as_query).groupBy("shard", "i", "j").applyInArrow(work, "u bigint, v bigint")


def classes(prints: DataFrame, radius: int = 4, **sizes: int) -> DataFrame:
    """(fp, root, component_id): each distinct fingerprint, one that all of its component share, and the component's smallest doc_id."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(linked(distinct, radius, **sizes))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``.

    Exact copies share a fingerprint and are one point of the search. Cases: null, empty and
    blank texts have fingerprint zero, linked like any other; repeated rows each give a row; a
    null id gives a row with a null id and counts for no component's smallest id (a component of
    null ids alone has a null component_id); an empty table gives no rows; long texts are read
    whole; other columns aren't read.
    """
    prints = stored(fingerprints(docs, size, id_col=id_col, text_col=text_col), "prints")
    by = classes(prints, radius, **sizes)
    return prints.join(by, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component; all columns stay.

    It is the one with the smallest id; of rows with that id the one whose text has the smallest hash,
    and of rows that repeat id and text the smallest by the other columns in their order. Cases: rows
    with a null id stay, as they can't stand for a component; null, empty and blank texts are copies of
    each other; an empty table gives no rows; long texts are read whole; columns may have any names.
    """
    known = docs.filter(F.col(id_col).isNotNull())
    prints = stored(fingerprints(known, size, id_col=id_col, text_col=text_col), "prints")
    of = prints.join(classes(prints, radius), "fp").groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n"))  # components may share an id
    heads = of.groupBy("root").agg(F.min(F.struct("doc_id", "mark", "n")).alias("h")).select("h.*")
    names = {x: f"_{x}" for x in ("doc_id", "mark", "n")}
    while set(names.values()) & set(docs.columns):
        names = {k: f"_{v}" for k, v in names.items()}
    heads = stored(heads.withColumnsRenamed(names), "heads")
    same = (F.col(id_col).cast("bigint") == F.col(names["doc_id"])) & (F.col(names["mark"]) == _mark(text_col))
    single, several = (known.join(heads.filter(x), same, "left_semi") for x in (F.col(names["n"]) == 1, F.col(names["n"]) > 1))
    # Each task reduces its repeated rows to one before the shuffle.
    least = several.groupBy(F.col(id_col).alias(names["doc_id"])).agg(F.min(F.struct(*docs.columns)).alias(names["n"])).select(f"{names['n']}.*")
    return single.unionByName(least).unionByName(docs.filter(F.col(id_col).isNull()))
