"""Exact top-k by inner product: ball-tree branch and bound per shard.

Vectors go to shards of bounded size (nearest of at most ``MAX_CLUSTERS``
centroids fitted on a bounded sample, large clusters split by id hash). Each
shard becomes one row: a ball tree over its vectors. Queries are searched
in blocks. A query first searches one shard of its own cluster; its k-th
score from there goes with it to every other shard whose cluster's
inner-product upper bound (q . centre + |q| radius) reaches it. In a shard,
nodes are taken in the order of their largest upper bound over the block's
queries, each query's k-th score is shared by all nodes that follow, and a
query leaves a node whose bound falls below it. The shards' lists are
merged by rank.

Scores are exact: inner products of floor(scale * x), in floats as long as
these are exact and in Python integers beyond, held within 64 bits. Ties go
to the smaller id. Null ids and vectors that are null, empty or hold null
or non-finite components take no part; vectors meet only those of their own
length; of rows with the same id the least vector counts. An empty table
gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import materialise
from llm.vectors import kmeans, nearest, sample_of, usable

LEAF = 64
SHARD_ROWS = 8192
MAX_CLUSTERS = 1024
#: Queries of a block, about.
BLOCK = 8192
#: Score of an empty place.
_NONE = -(2**63) + 1


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q @ x.T of whole numbers, exact, as 64-bit integers."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(exact, _NONE + 1, 2**63 - 1).astype(np.int64)


class BallTree:
    """Flat arrays: node i has the rows low[i]..high[i]-1; its children are child[i] and child[i] + 1, or it is a leaf (0)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order, low, high, child = np.lexsort((ids,)), [0], [len(ids)], [0]
        at = 0
        while at < len(low):
            if high[at] - low[at] > LEAF:
                rows = order[low[at]:high[at]]
                part = points[rows]
                dim = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                order[low[at]:high[at]] = rows[np.argsort(part[:, dim], kind="stable")]
                middle = (low[at] + high[at]) // 2
                child[at] = len(low)
                low += [low[at], middle]
                high += [middle, high[at]]
                child += [0, 0]
            at += 1
        self.ids, self.points = ids[order], points[order]
        self.low, self.high, self.child = np.array(low), np.array(high), np.array(child)
        self.centre = np.array([self.points[a:b].mean(axis=0) for a, b in zip(low, high)])
        self.radius = np.array([np.sqrt(((self.points[a:b] - c)**2).sum(axis=1).max()) for a, b, c in zip(low, high, self.centre)])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (k per query, best first) and ids; ``kth``: known lower bounds of the k-th scores. Empty places score ``_NONE``."""
        scores = np.full((len(queries), k), _NONE)
        found = np.full((len(queries), k), np.iinfo(np.int64).max)
        kth = kth.copy()
        norm = np.sqrt((queries**2).sum(axis=1))

        def bounds(node: int, who: np.ndarray) -> np.ndarray:
            top = queries[who] @ self.centre[node] + norm[who] * self.radius[node]
            return top + 1e-9 * (np.abs(top) + norm[who] * (self.radius[node] + np.abs(self.centre[node]).sum())) + 1e-6

        everyone = np.arange(len(queries))
        heap = [(-float(bounds(0, everyone).max(initial=-np.inf)), 0, everyone)] if len(queries) else []
        while heap:
            _, node, who = heapq.heappop(heap)
            who = who[bounds(node, who) >= kth[who]]
            if not len(who):
                continue
            if self.child[node]:
                for child in (self.child[node], self.child[node] + 1):
                    b = bounds(child, who)
                    some = who[b >= kth[who]]
                    if len(some):
                        heapq.heappush(heap, (-float(b.max()), int(child), some))
                continue
            rows = slice(self.low[node], self.high[node])
            ids = self.ids[rows]
            for part in np.array_split(who, -(-len(who) // 2048)):
                got = products(queries[part], self.points[rows])
                got[ids[None, :] == query_ids[part][:, None]] = _NONE
                better = np.flatnonzero((got >= kth[part][:, None]).any(axis=1))
                if not len(better):
                    continue
                mine = part[better]
                s = np.concatenate([scores[mine], got[better]], axis=1)
                i = np.concatenate([found[mine], np.broadcast_to(ids, (len(better), len(ids)))], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                scores[mine], found[mine] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                kth[mine] = np.maximum(kth[mine], scores[mine, k - 1])
        return scores, found

    def dump(self) -> bytes:
        head = np.array([len(self.ids), self.points.shape[1], len(self.low)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.ids, self.points, self.low, self.high, self.child, self.centre, self.radius))

    @classmethod
    def load(cls, data: bytes) -> BallTree:
        n, d, m = (int(x) for x in np.frombuffer(data, "<i8", 3))
        out, at = cls.__new__(cls), 24
        for name, kind, shape in (("ids", "<i8", (n,)), ("points", "<f8", (n, d)), ("low", "<i8", (m,)), ("high", "<i8", (m,)), ("child", "<i8", (m,)), ("centre", "<f8", (m, d)), ("radius", "<f8", (m,))):
            a = np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape)
            setattr(out, name, a)
            at += a.nbytes
        return out


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), float)


def top_k(df: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: the k highest inner products of each row for which ``queries`` (on ``id``) holds."""
    rows = materialise(usable(df, id_col, vec_col).select("id", F.expr(f"transform(vec, x -> double(floor({float(scale)}D * x)))").alias("vec")), "vectors")
    none = "query_id long, rank int, id long, score long"
    found = None
    for r in rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():
        one = _top_k_of(rows.where(F.size("vec") == r.dim), queries, k, r.dim, r.n)
        found = one if found is None else found.union(one)
    if found is None:
        return df.sparkSession.createDataFrame([], none).withColumnRenamed("id", id_col)
    return found.withColumnRenamed("id", id_col)


def _top_k_of(rows: DataFrame, queries: Column, k: int, dim: int, n: int) -> DataFrame:
    spark = rows.sparkSession
    centres = kmeans(sample_of(rows, dim), max(1, min(MAX_CLUSTERS, n // SHARD_ROWS)))
    sent = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("struct<cluster: long, far: double>")
    def place(vec: pd.Series) -> pd.DataFrame:
        x = _matrix(vec)
        own = nearest(x, sent.value, 1)[:, 0]
        return pd.DataFrame({"cluster": own, "far": np.sqrt(((x - sent.value[own])**2).sum(axis=1))})

    placed = materialise(rows.withColumn("p", place("vec")).select("id", "vec", "p.cluster", "p.far", queries.alias("asks")), "placed")
    clusters = {r.cluster: r for r in placed.groupBy("cluster").agg(
        F.count("*").alias("n"), F.max("far").alias("radius"), F.sum(F.col("asks").cast("long")).alias("asks")).collect()}  # at most MAX_CLUSTERS rows
    parts = {c: -(-r.n // SHARD_ROWS) for c, r in clusters.items()}
    blocks = max(1, -(-sum(r.asks or 0 for r in clusters.values()) // BLOCK))
    part_of = spark.sparkContext.broadcast(parts)

    @F.pandas_udf("long")
    def part(cluster: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([x % part_of.value[c] for c, x in zip(cluster, h)], dtype=np.int64)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(pdf["id"].to_numpy(np.int64), _matrix(pdf["vec"]))
        return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "part": [pdf["part"].iloc[0]], "tree": [tree.dump()]})

    sharded = placed.withColumn("part", part("cluster", F.xxhash64("id")))
    trees = materialise(sharded.groupBy("cluster", "part").applyInPandas(build, "cluster long, part long, tree binary"), "trees")
    asking = sharded.where("asks").withColumn("block", F.expr(f"pmod(xxhash64(id, 7), {blocks})"))
    each = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def search(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "id": [], "score": []}, dtype="int64")
        if not len(asked) or not len(shard):
            return out
        tree, ids = BallTree.load(shard["tree"].iloc[0]), asked["id"].to_numpy(np.int64)
        kth = asked["kth"].to_numpy(np.int64) if "kth" in asked else np.full(len(asked), _NONE)
        scores, found = tree.search(ids, _matrix(asked["vec"]), k, kth)
        q, at = np.nonzero(scores > _NONE)
        return pd.DataFrame({"query_id": ids[q], "id": found[q, at], "score": scores[q, at]})

    keys, schema = ["cluster", "part", "block"], "query_id long, id long, score long"
    home = asking.select(*keys, "id", "vec").groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(search, schema)
    home = materialise(home, "home")
    kth = home.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(F.col("c") >= k).select("query_id", F.col("s").alias("kth"))
    balls = spark.sparkContext.broadcast(pd.DataFrame(
        [(c, r.radius, parts[c]) for c, r in sorted(clusters.items())], columns=["cluster", "radius", "parts"]))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = balls.value
        mid, radius, n_parts = sent.value[b["cluster"]], b["radius"].to_numpy(), b["parts"].to_numpy()
        for pdf in batches:
            for some in np.array_split(np.arange(len(pdf)), max(1, len(pdf) // 512)):
                one = pdf.iloc[some]
                if not len(one):
                    continue
                x = _matrix(one["vec"])
                norm = np.sqrt((x**2).sum(axis=1))
                top = x @ mid.T + norm[:, None] * radius
                top += 1e-9 * np.abs(top) + 1e-6 * (1 + norm[:, None])
                q, c = np.nonzero(~(top < one["kth"].to_numpy(float)[:, None]))
                n = n_parts[c]
                p = np.concatenate([np.arange(m) for m in n]) if len(n) else np.zeros(0, np.int64)
                q, c = np.repeat(q, n), np.repeat(c, n)
                new = (b["cluster"].to_numpy()[c] != one["cluster"].to_numpy()[q]) | (p != one["part"].to_numpy()[q])
                out = one.iloc[q[new]][["id", "vec", "kth", "block"]].copy()
                out["cluster"], out["part"] = b["cluster"].to_numpy()[c[new]], p[new]
                yield out

    rest = asking.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "vec", F.coalesce("kth", F.lit(_NONE)).alias("kth"), "cluster", "part", "block")
    rest = rest.mapInPandas(spread, "id long, vec array<double>, kth long, block long, cluster long, part long")
    others = rest.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = home.union(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
