"""Helpers for embedding tables: usable rows, k-means on a bounded sample, nearest centroids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that centroids are fitted on at most: those with the smallest id hash.
SAMPLE = 16_384


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)`` with doubles: one row per id (the least vector), without null, empty or non-finite vectors."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = "id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return rows.where(fine).groupBy("id").agg(F.min("vec").alias("vec"))


def sample_of(rows: DataFrame, dim: int, most: int = SAMPLE) -> np.ndarray:
    """At most ``most`` vectors of the dimension, chosen by hash of their id."""
    got = rows.where(F.size("vec") == dim).orderBy(F.xxhash64("id"), "id").limit(most).select("vec").toPandas()["vec"]
    return np.array(got.tolist(), float).reshape(-1, dim)


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centroids of ``points`` (fewer than k if points repeat)."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[np.sort(rng.choice(len(distinct), min(k, len(distinct)), replace=False))]
    for _ in range(rounds):
        own = nearest(points, centres, 1)[:, 0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centres of each point, nearest first."""
    count = min(count, len(centres))
    out = np.zeros((len(points), count), np.int64)
    square = (centres**2).sum(axis=1)
    for at in range(0, len(points), 4096):
        d = square - 2 * points[at:at + 4096] @ centres.T
        some = np.argpartition(d, count - 1, axis=1)[:, :count]
        order = np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable")
        out[at:at + 4096] = np.take_along_axis(some, order, 1)
    return out
