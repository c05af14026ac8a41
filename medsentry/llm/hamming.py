"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments, and each segment's index is cut into shards by the segment's leading
bits. In a round of radius r every open query goes, for each segment, to the shards within r bits
of its own leading bits; there it looks up the codes whose segment differs from its own in exactly
r bits. After a round, any code within ``segments * (r + 1) - 1`` bits has been seen, so a query
is closed once its kth verified distance is no larger. Look-ups and candidates stay inside the
task; only a query's k nearest leave it. Equal codes are one entry of the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored

BITS = 64
#: Codes and queries that a task holds at once, and look-ups or candidates that it works on at once.
SHARD, ASKED, LOT = 65_536, 262_144, 1 << 20


def code(vector: str) -> Column:
    """Signs of a vector's components as a 64-bit integer; missing, null and NaN components and null vectors are zeros.

    A vector of more than 64 components is an error, as its code would leave some of it out.
    """
    bits = F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (c, i) -> c | if(coalesce(get(`{vector}`, i) > 0 and not isnan(get(`{vector}`, i)), false), shiftleft(1L, i), 0L))")
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a vector has more than {BITS} components")).cast("bigint")).otherwise(bits)


def _smallest(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each task's groups to k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


class Cut:
    """How codes are cut: ``segments`` of about ``width`` bits, of which the first ``lead`` bits name the shard."""

    def __init__(self, segments: int, lead: int):
        self.segments, self.width = segments, -(-BITS // segments)
        #: (shift, bits) of each segment.
        self.at = [(j * self.width, min(self.width, BITS - j * self.width)) for j in range(segments) if j * self.width < BITS]
        self.segments, self.lead = len(self.at), min(lead, self.at[-1][1])

    def segment(self, codes: np.ndarray, j: int) -> np.ndarray:
        shift, bits = self.at[j]
        return (codes >> np.uint64(shift)) & np.uint64(2**bits - 1)

    def low(self, j: int) -> int:
        """The number of bits after the leading ones."""
        return self.at[j][1] - self.lead


@cache
def flips(bits: int, radius: int) -> np.ndarray:
    """All masks of ``radius`` of ``bits`` bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.uint64)


def look_up(cut: Cut, j: int, prefix: int, codes: np.ndarray, firsts: np.ndarray, asked: np.ndarray, far: np.ndarray, radii: tuple[int, ...], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance, first): the k best by (distance, first) for each query, among the codes of one shard.

    ``codes`` have ``prefix`` as the leading bits of segment ``j``. A code is met if its segment differs from
    the query's in one of ``radii`` bits and no other segment differs less, nor an earlier one as little:
    so it is met once in all shards and rounds. Codes beyond ``far`` are left out.
    """
    bits = cut.low(j)
    mask = np.uint64(2**bits - 1)
    value = cut.segment(codes, j) & mask
    order = np.argsort(value, kind="stable")
    codes, firsts, value = codes[order], firsts[order], value[order]
    keys, begin = np.unique(value, return_index=True)
    end = np.append(begin[1:], len(value))
    own = cut.segment(asked, j)
    low, apart = own & mask, np.bitwise_count((own >> np.uint64(bits)) ^ np.uint64(prefix)).astype(int)
    best = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def meet(q: np.ndarray, key: np.ndarray, radius: int) -> None:
        """Verify the codes under keys[key[i]] for query q[i], in lots."""
        nonlocal best
        n = end[key] - begin[key]
        total = np.cumsum(n)
        a = 0
        while a < len(q):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LOT, "right")))
            m = n[a:b]
            row = np.repeat(begin[key[a:b]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            who = np.repeat(q[a:b], m)
            x = codes[row] ^ asked[who]
            d = np.bitwise_count(x).astype(np.int64)
            keep = d <= far[who]
            row, who, x, d = row[keep], who[keep], x[keep], d[keep]
            for i in range(cut.segments):
                if i != j and len(x):
                    other = np.bitwise_count(cut.segment(x, i))
                    keep = (other > radius) if i < j else (other >= radius)
                    row, who, x, d = row[keep], who[keep], x[keep], d[keep]
            if len(who):
                found = [np.concatenate(p) for p in zip(best, (who, codes[row], d, firsts[row]), strict=True)]
                order = np.lexsort((found[3], found[2], found[0]))
                found = [p[order] for p in found]
                new = np.append(True, found[0][1:] != found[0][:-1])
                at = np.arange(len(new))
                keep = at - np.maximum.accumulate(np.where(new, at, 0)) < k
                best = [p[keep] for p in found]
            a = b

    for radius in radii:
        for near in range(min(radius, cut.lead) + 1):
            left = radius - near
            who = np.nonzero(apart == near)[0]
            if left > bits or not len(who) or not len(keys):
                continue
            # The keys are looked up by their flips, or by running through them where they are fewer.
            run = math.comb(bits, left) > len(keys)
            width = len(keys) if run else math.comb(bits, left)
            for at in range(0, len(who), max(1, LOT // width)):
                some = who[at : at + max(1, LOT // width)]
                if run:
                    q, key = np.nonzero(np.bitwise_count(low[some, None] ^ keys[None, :]) == left)
                else:
                    want = low[some, None] ^ flips(bits, left)[None, :]
                    place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    hit = keys[place] == want
                    q, key = np.nonzero(hit)[0], place[hit]
                meet(some[q], key, radius)
    return best[0], best[1], best[2], best[3]


def _sharded(rows: DataFrame, cut: Cut, radii: tuple[int, ...] | None) -> DataFrame:
    """(seg, prefix, code, x) for each segment of the rows (code, x): the own shard, or those within the largest of ``radii``."""
    near = np.zeros(1, np.uint64) if radii is None else np.concatenate([flips(cut.lead, r) for r in range(min(max(radii), cut.lead) + 1)])

    def make():
        def each(batch):
            codes, xs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lot = max(1, LOT // len(near))
            for at in range(0, len(codes), lot):
                c, x = codes[at : at + lot], xs[at : at + lot]
                for j in range(cut.segments):
                    prefix = (cut.segment(c.view(np.uint64), j) >> np.uint64(cut.low(j)))[:, None] ^ near[None, :]
                    yield {"seg": np.full(prefix.size, j, np.int32), "prefix": prefix.ravel().view(np.int64), "code": np.repeat(c, len(near)), "x": np.repeat(x, len(near))}

        return each

    schema = pa.schema([("seg", pa.int32()), ("prefix", pa.int64()), ("code", pa.int64()), ("x", pa.int64())])
    return map_batches(rows, make, schema, "seg int, prefix bigint, code bigint, x bigint")


def _dealt(index: DataFrame, asked: DataFrame, shard: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Both with a place in a grid of blocks of codes against blocks of queries, so no task holds more than one of each.

    Sizes are counted and joined; a shard that no query asks for drops out.
    """
    blocks = lambda n: F.ceil(F.col("n") / n).cast("int")
    gh = index.groupBy("seg", "prefix").agg(F.count("*").alias("n")).select("seg", "prefix", blocks(shard).alias("gh"))
    gq = asked.groupBy("seg", "prefix").agg(F.count("*").alias("n")).select("seg", "prefix", blocks(most).alias("gq"))
    plan = stored(gh.join(gq, ["seg", "prefix"]), "grid")
    salt = F.xxhash64("code", F.lit(11))
    as_code = index.join(plan, ["seg", "prefix"]).withColumn("i", F.pmod(salt, "gh").cast("int")).withColumn("j", F.explode(F.expr("sequence(0, gq - 1)")))
    as_query = asked.join(plan, ["seg", "prefix"]).withColumn("j", F.pmod(salt, "gq").cast("int")).withColumn("i", F.explode(F.expr("sequence(0, gh - 1)")))
    return as_code.select("seg", "prefix", "i", "j", "code", "x"), as_query.select("seg", "prefix", "i", "j", "code", "x")


def search(index: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None, shard: int = SHARD, most: int = ASKED) -> DataFrame:
    """(code, id, distance): for each distinct code of ``queries`` the k nearest rows of ``index`` by (distance, id).

    Both have columns id and code. ``segments`` follows from the index's size unless given: a
    segment has about as many bits as it takes to number the codes. A shard of more than
    ``shard`` codes, or asked for by more than ``most`` queries, is dealt out by hash.
    """
    whole = stored(_smallest(index.select("id", "code"), "code", ["id"], k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    n = whole.count()
    m = segments or max(1, min(8, round(BITS / max(8, math.log2(max(2, n))))))
    cut = Cut(m, max(0, math.ceil(math.log2(max(1, n / shard)))))
    sharded = stored(_sharded(whole.select("code", F.col("ids")[0].alias("x")), cut, None), "shards")
    open_ = stored(queries.select("code").distinct().select("code", F.lit(BITS).cast("bigint").alias("x")), "open")
    done, best, radii, left = [], None, (0, 1), open_.count()

    def work(key: tuple, codes: pa.Table, asked: pa.Table) -> pa.Table:
        far = asked.column("x").to_numpy()
        names = asked.column("code").to_numpy()
        q, c, d, first = look_up(cut, key[0].as_py(), key[1].as_py(), codes.column("code").to_numpy().view(np.uint64), codes.column("x").to_numpy(), names.view(np.uint64), far, radii, k)
        return pa.table({"code": names[q], "other": c.view(np.int64), "distance": d, "first": first})

    while left:
        place = ["seg", "prefix", "i", "j"]
        as_code, as_query = _dealt(sharded, _sharded(open_, cut, radii), shard, most)
        new = as_code.groupBy(*place).cogroup(as_query.groupBy(*place)).applyInArrow(work, "code bigint, other bigint, distance bigint, first bigint")
        best = stored(_smallest(new if best is None else new.unionByName(best), "code", ["distance", "first"], k), "best")
        covered = cut.segments * (radii[-1] + 1) - 1
        state = best.groupBy("code").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        every = covered >= BITS or radii[-1] >= cut.width  # no code is left unseen
        state = state.withColumn("closed", (F.col("n") >= k) & (F.col("far") <= covered) | F.lit(every))
        # Until k codes are known a query has no bound on its distance.
        state = stored(open_.select("code").join(state, "code", "left").select("code", F.when(F.col("n") >= k, F.col("far")).otherwise(BITS).cast("bigint").alias("x"), F.coalesce("closed", F.lit(every)).alias("closed")), "state")
        closed = state.filter("closed").select("code")
        done.append(best.join(closed, "code", "left_semi"))
        open_, best = state.filter("not closed").select("code", "x"), best.join(closed, "code", "left_anti")
        left, radii = open_.count(), (radii[-1] + 1,)
    if not done:
        return open_.select("code", F.lit(0).cast("bigint").alias("id"), F.lit(0).alias("distance")).limit(0)
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    # The k nearest codes by (distance, smallest id) have the k nearest rows among them.
    rows = found.select(F.col("code").alias("query"), "other", F.col("distance").cast("int").alias("distance")).join(whole, F.col("other") == whole.code).select(F.col("query").alias("code"), F.explode("ids").alias("id"), "distance")
    return _smallest(rows, "code", ["distance", "id"], k)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, distance: the k rows nearest to each query in Hamming distance of sign codes, ties by id.

    A query that is itself a row finds itself. Cases: null and empty vectors have the code zero, NaN
    counts as not positive; with fewer than k rows all are returned; repeated rows count as often as
    they occur among the k; a repeated query row repeats its answer; rows with a null id are not
    searched for; vectors of more than 64 components raise; other columns are not read.
    """
    index = rows.select(F.col(id_col).cast("bigint").alias("id"), code(vector_col).alias("code")).filter("id is not null")
    asked = stored(queries.select(F.col(id_col).cast("bigint").alias("query_id"), code(vector_col).alias("code")).filter("query_id is not null"), "queries")
    found = search(index, asked, k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("distance", "id")))
    return asked.join(ranked, "code").select("query_id", "rank", "id", "distance")
