"""Exact integer k-means whose assignment is a threshold algorithm over sorted centroid lists.

For every dimension the centroids' values are a sorted list. A vector walks
each list outward from its own value, always to the nearer of the next two
entries; a centroid met for the first time gets its exact distance. No
centroid that is still unmet can be nearer than the sum over all dimensions
of the squared gap to the next entry, so a vector stops when this sum
strictly exceeds its best distance (at equality an unmet centroid with a
smaller number could still tie).

Components become integers, floor(scale * x), so distances, sums and means
are exact and don't depend on partitioning. A round is one pass over the
stored integer vectors: tasks add up their vectors by cluster, Spark adds
up the tasks' sums, and k * dims numbers reach the driver.

Defined cases: vectors that are null, of another length, or hold a null or
non-finite component take no part (no row). Repeated rows are vectors of
their own. A null id hashes last and is returned as null. Fewer than k
vectors make fewer clusters, an empty table none. A scaled component
beyond 2 ** 27 is an error, since its squared distances don't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import materialise

LIMIT = 1 << 27
#: Vectors that are assigned together.
CHUNK = 2048
_FAR = 2 * LIMIT + 1  # farther than any gap; 64 squares of it fit a long


class Lists:
    """Per dimension the centroids in order of their value."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids  # k x dims
        order = np.argsort(centroids, axis=0, kind="stable")
        self.ids = order.T.copy()  # dims x k
        self.values = np.take_along_axis(centroids, order, axis=0).T.copy()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (ties: the smallest number) and its squared distance."""
        own, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), CHUNK):
            own[at:at + CHUNK], far[at:at + CHUNK], _ = self.walk(x[at:at + CHUNK])
        return own, far

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, squared distance and number of centroids whose distance was computed."""
        n, dims = x.shape
        k = len(self.centroids)
        right = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in range(dims)], axis=1)
        left = right - 1
        seen = np.zeros((n, k), bool)
        best, own = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        todo, d = np.arange(n), np.arange(dims)
        while len(todo):
            y, lo, hi = x[todo], left[todo], right[todo]
            down, up = self._gaps(y, lo, hi)
            go_down = down <= up
            at = np.where(go_down, lo, hi)
            met = np.zeros((len(todo), k), bool)
            valid = np.minimum(down, up) < _FAR
            rows = np.broadcast_to(np.arange(len(todo))[:, None], at.shape)
            met[rows[valid], self.ids[np.broadcast_to(d, at.shape)[valid], at[valid]]] = True
            new = met & ~seen[todo]
            seen[todo] |= met
            r, c = np.nonzero(new)
            dist = np.full((len(todo), k), np.iinfo(np.int64).max)
            dist[r, c] = ((y[r] - self.centroids[c]) ** 2).sum(axis=1)
            c = dist.argmin(axis=1)  # the first, so the smallest number, of equal ones
            dist = dist[np.arange(len(todo)), c]
            better = (dist < best[todo]) | (dist == best[todo]) & (c < own[todo])
            best[todo[better]], own[todo[better]] = dist[better], c[better]
            left[todo], right[todo] = lo - (valid & go_down), hi + (valid & ~go_down)
            frontier = np.minimum(*self._gaps(y, left[todo], right[todo]))
            go_on = ((frontier**2).sum(axis=1) <= best[todo]) & ~seen[todo].all(axis=1)
            todo = todo[go_on]
        return own, best, seen.sum(axis=1)

    def _gaps(self, y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gaps to the next entry below and above; _FAR beyond a list's end."""
        d, k = np.arange(y.shape[1]), len(self.centroids)
        down = np.where(lo >= 0, y - self.values[d, np.maximum(lo, 0)], _FAR)
        return down, np.where(hi < k, self.values[d, np.minimum(hi, k - 1)] - y, _FAR)


def vectors_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def integers(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``(id, v)``: the vectors that take part, as integers."""
    finite = f"size(vec) = {dims} and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(finite)
    cell = (f"if(floor({scale} * x) between -{LIMIT} and {LIMIT}, cast(floor({scale} * x) as int), "
            f"cast(raise_error('a scaled component is beyond {LIMIT}') as int))")
    return rows.selectExpr("id", f"transform(vec, x -> {cell}) as v")


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the exact floored means of their vectors; those without any stay."""
    k, dims = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, sums, n = Lists(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = vectors_of(batch, dims)
            own, _ = lists.nearest(x)
            np.add.at(sums, own, x)
            n += np.bincount(own, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array([[int(n[c]), *sums[c].tolist()] for c in some], pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = rows.select("v").mapInArrow(add_up, "cluster int, sums array<long>")
    total = parts.selectExpr("cluster", "posexplode(sums) as (place, x)").groupBy("cluster", "place") \
        .agg(F.expr("sum(cast(x as decimal(38, 0)))").alias("x")).collect()
    exact = {(r.cluster, r.place): int(r.x) for r in total}
    out = centroids.copy()
    for c in {c for c, _ in exact}:
        out[c] = [exact[c, d + 1] // exact[c, 0] for d in range(dims)]
    return out


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10,
            dims: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector that takes part.

    Centroids start as the k vectors with the smallest sha256 of ``<seed>:<id>``, and after ``rounds`` rounds
    the vectors are assigned once more.
    """
    if dims * _FAR**2 >= 2**63:
        raise ValueError("too many dimensions for exact distances in 64 bits")
    spark = df.sparkSession
    rows = materialise(integers(df, id_col, vec_col, dims, scale), "vectors")
    start = rows.orderBy(F.expr(f"sha2(concat('{seed}:', id), 256)").asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in start], np.int64).reshape(-1, dims)
    names = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], names)
    for _ in range(rounds):
        centroids = _moved(rows, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            own, far = lists.nearest(vectors_of(batch, dims))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])

    assigned = materialise(rows.mapInArrow(assign, "id long, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.x) for r in assigned.groupBy("cluster").agg(F.expr("sum(cast(distance as decimal(38, 0)))").alias("x")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = ", ".join(f"{sums.get(c, 0)}L" for c in range(len(centroids)))
    shas = ", ".join(f"'{s}'" for s in digests)
    return assigned.selectExpr(f"id as `{id_col}`", "cluster", "distance", f"element_at(array({own}), cluster + 1) as cluster_inertia",
                               f"{sum(sums.values())}L as inertia", f"element_at(array({shas}), cluster + 1) as centroid_sha256")
