"""Centroid clustering by delta Lloyd: each round compares and sums only what changed.

A vector's state is its owner and its distance to it. After a round, distances to centroids that
stayed are known to be no smaller than the owner's, so a vector is compared with the changed
centroids alone; only if its own centroid moved away from it are the others looked at again. Sums
and counts of all clusters are kept, and a round adds the signed transfers of vectors that changed
owners: no vector that stayed is read for the new centroids. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, stored

#: Vectors compared at once in a task, and the largest component: distances stay below 2**62.
BLOCK, LARGEST = 4096, 1 << 27
#: Up to this component all sums of squares are exact in doubles, so matrix products do the work.
_EXACT = 1 << 22
_STATE = pa.schema([("id", pa.int64()), ("q", pa.list_(pa.int64())), ("owner", pa.int32()), ("distance", pa.int64()), ("was", pa.int32()), ("moved", pa.bool_())])
_STATE_SQL = "id bigint, q array<bigint>, owner int, distance bigint, was int, moved boolean"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """(id, q): the vectors of exactly ``components`` finite components, each as floor(scale * x)."""
    v, x = F.col(vector_col), F.col(id_col).cast("bigint")
    finite: Column = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    q = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    rows = rows.filter((F.size(v) == components) & finite).select(x.alias("id"), q.alias("q"))
    far = F.exists("q", lambda c: (c > LARGEST) | (c < -LARGEST))
    return rows.withColumn("q", F.when(far, F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}")).cast("array<bigint>")).otherwise(F.col("q")))


def starts(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The ``clusters`` vectors whose ``seed:id`` has the smallest SHA-256, in its order; a null id counts as empty text."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.select(mark.alias("mark"), "q").orderBy("mark", "q").limit(clusters).collect()
    return np.array([r.q for r in first], np.int64)


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``q`` to all ``centroids``."""
    if not len(centroids):
        return np.zeros((len(q), 0), np.int64)
    if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        a, b = q.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((q - c) ** 2).sum(1) for c in centroids], 1)


def reassign(q: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New (owner, distance) after the ``changed`` centroids (numbers, ascending) took new places; owner -1: not assigned yet.

    Ties go to the smaller number. A centroid that stayed is no nearer than the old distance, and if it
    is as near it has a larger number than the old owner; so it can win only where the owner moved off.
    """
    k = len(centroids)
    own_changed = np.isin(owner, changed)
    near = distances(q, centroids[changed])
    best, at = distance.copy(), owner.copy()
    # A changed owner's old distance is void: its new one comes with the changed centroids.
    own = np.full(len(q), -1, np.int64)
    own[own_changed] = near[np.nonzero(own_changed)[0], np.searchsorted(changed, owner[own_changed])]
    again = (owner < 0) | (own_changed & (own > distance))
    some = own_changed & ~again
    best[some] = own[some]
    if again.any():
        every = distances(q[again], centroids)
        at[again] = every.argmin(1)
        best[again] = every[np.arange(len(every)), at[again]]
    if len(changed) and (~again).any():
        rest = np.nonzero(~again)[0]
        d = near[rest]
        j = d.argmin(1)
        d, j = d[np.arange(len(rest)), j], changed[j]
        wins = (d < best[rest]) | ((d == best[rest]) & (j < at[rest]))
        best[rest[wins]], at[rest[wins]] = d[wins], j[wins]
    assert k == 0 or at.min(initial=0) >= 0
    return at, best


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assign(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The next state of every vector; ``moved`` tells whether its owner is another one."""

    def make():
        def each(batch):
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                q = _matrix(some.column("q"))
                old = some.column("owner").to_numpy().astype(np.int64)
                owner, distance = reassign(q, old, some.column("distance").to_numpy().copy(), centroids, changed)
                yield {"id": some.column("id"), "q": some.column("q"), "owner": owner.astype(np.int32), "distance": distance, "was": old.astype(np.int32), "moved": owner != old}

        return each

    return map_batches(state.select("id", "q", "owner", "distance"), make, _STATE, _STATE_SQL)


def transfers(state: DataFrame, clusters: int) -> list[tuple[int, int, int]]:
    """(cluster, component, amount) of what vectors with a new owner take from the old one and bring; component -1 is their number.

    A task sums its own vectors, so at most clusters * (components + 1) rows a task are shuffled, and as many reach the driver.
    """
    schema = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("amount", pa.int64())])

    def run(batches):
        total = None
        for batch in batches:
            q = _matrix(batch.column("q"))
            if not len(q):
                continue
            q = np.concatenate((q, np.ones((len(q), 1), np.int64)), 1)
            if total is None:
                total = np.zeros((clusters, q.shape[1]), np.int64)
            owner, was = batch.column("owner").to_numpy(), batch.column("was").to_numpy()
            for j in range(clusters):
                total[j] += q[owner == j].sum(0) - q[was == j].sum(0)
        if total is not None:
            j, c = np.nonzero(total)
            yield pa.record_batch([pa.array(j, pa.int32()), pa.array(np.where(c == total.shape[1] - 1, -1, c), pa.int32()), pa.array(total[j, c])], schema=schema)

    parts = state.filter("moved").select("q", "owner", "was").mapInArrow(run, "cluster int, component int, amount bigint")
    summed = parts.groupBy("cluster", "component").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    return [(r.cluster, r.component, int(r.amount)) for r in summed.collect()]


def cluster(rows: DataFrame, clusters: int = 16, rounds: int = 3, seed: int = 1, components: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector, after ``rounds`` of Lloyd's algorithm and one more assignment.

    Cases: vectors that are null, have another number of components, or one that is null or not finite,
    have no row; with fewer vectors than clusters each is a start; repeated rows count each, and equal
    starts leave the later one empty, where it stays; a null id counts as empty text in the order of
    starts, and ties there go by components; no kept vector gives no rows; components beyond 2**27 in
    whole numbers raise; other columns are not read. States are written to the shared folder, the moved
    vectors apart, so sums read those alone; ``clusters`` * ``components`` numbers reach the driver.
    """
    vectors = whole_vectors(rows, id_col, vector_col, components, scale)
    state = stored(vectors.select("id", "q", F.lit(-1).alias("owner"), F.lit(0).cast("bigint").alias("distance")), "vectors")
    centroids = starts(state, clusters, seed)
    k = len(centroids)
    changed, sums, counts = np.arange(k), [[0] * components for _ in range(k)], [0] * k
    for round_ in range(rounds + 1):
        if not len(changed):
            break
        new = stored(assign(state, centroids, changed), "state", "moved")
        discard(state)
        state = new
        if round_ == rounds:
            break
        for j, c, amount in transfers(state, k):
            if c < 0:
                counts[j] += amount
            else:
                sums[j][c] += amount
        next_ = np.array([[s // counts[j] for s in sums[j]] if counts[j] else centroids[j].tolist() for j in range(k)], np.int64)
        changed, centroids = np.nonzero((next_ != centroids).any(1))[0], next_
    within = {r.owner: int(r.d) for r in state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = rows.sparkSession.createDataFrame([(j, within.get(j, 0), sum(within.values()), digest[j]) for j in range(k)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    owned = state.select(F.col("id").alias("vec_id"), F.col("owner").alias("cluster"), "distance")
    return owned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # ``clusters`` rows are broadcast
