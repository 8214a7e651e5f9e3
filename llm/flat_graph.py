"""Near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors are one class. Classes go to overlapping shards: those of
their ``OVERLAP`` nearest centroids (at most ``MAX_CLUSTERS``, fitted on a
bounded sample). Each shard builds a flat graph: a class's near neighbours
and some random ones, robust-pruned (an edge goes if a kept neighbour is
``ALPHA`` times closer to its end). The shards' adjacency lists are united
per class. Each class is then searched in the shard of its nearest
centroid (its home): greedily from the medoid with a beam, then expanding
everything in range. What is found is verified in double precision. A link
counts for both its ends, in one shard: that of the home that holds both,
the smaller one if both homes do, where then both ends ask. A recall audit
compares classes chosen by hash with brute force over all vectors, until
enough of them have a link or a twentieth of all is compared; each linked class
counts the same, however many links it has. Below
``RECALL`` the graph is built again with more overlap, up to all shards
(each class in every shard: then only the graph walk can miss); below
``LEAST_RECALL`` even then, it is an error.

Large clusters are split by hash into parts, and a task has two of them that
search each other, so no group grows with the data. A task keeps a bit for
each pair of its rows, and sends a spanning forest of its links, not the links.

Vectors that are null, empty, zero or hold null or non-finite components
link with nothing and keep their row, as do null ids. Vectors meet only
those of their own length. Rows repeat as they come; rows with the same id
count as copies if their vectors are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import materialise
from llm.components import connected_components
from llm.vectors import kmeans, nearest, sample_of

OVERLAP = 3
MAX_CLUSTERS = 2048
CLUSTER_ROWS = 1500
PART_ROWS = 12_000
NEAR, RANDOM, DEGREE, ALPHA = 32, 16, 24, 1.2
BEAM = 24
#: Classes of an audit's first block; the next ones are larger, up to 16 times.
AUDITED = 256
#: Audited classes with a link that are enough.
LINKED = 128
RECALL, LEAST_RECALL = 0.97, 0.9
_BLOCK = 256
#: Pairs worked on at a time.
_PAIRS = 65_536


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def build_graph(x: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Neighbours of each row of unit vectors ``x``."""
    n, rng = len(x), np.random.default_rng(seed)
    if n <= DEGREE + 1:
        return [np.delete(np.arange(n), i) for i in range(n)]
    near = min(NEAR, n - 1)
    out: list[np.ndarray] = []
    for at in range(0, n, _BLOCK):
        rows = np.arange(at, min(at + _BLOCK, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -2
        pool = np.concatenate([np.argpartition(-sims, near - 1, axis=1)[:, :near], rng.integers(0, n, (len(rows), RANDOM))], axis=1)
        away = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, pool, 1)))
        order = np.argsort(away, axis=1, kind="stable")
        pool, away = np.take_along_axis(pool, order, 1), np.take_along_axis(away, order, 1)
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bid,bjd->bij", x[pool], x[pool])))
        alive, kept = pool != rows[:, None], np.zeros(pool.shape, bool)
        for j in range(pool.shape[1]):
            kept[:, j] = alive[:, j] & (kept.sum(axis=1) < DEGREE)
            gone = kept[:, j, None] & (ALPHA * between[:, j] <= away)
            gone[:, :j + 1] = False
            alive &= ~gone & ~(kept[:, j, None] & (pool == pool[:, j, None]))
        out += [pool[i][kept[i]] for i in range(len(rows))]
    return _reachable(x, _both_ways(out))


def _both_ways(graph: list[np.ndarray]) -> list[np.ndarray]:
    a = np.repeat(np.arange(len(graph)), [len(g) for g in graph])
    b = np.concatenate(graph).astype(np.int64)
    key = np.unique(np.concatenate([a * len(graph) + b, b * len(graph) + a]))
    return np.split(key % len(graph), np.searchsorted(key // len(graph), np.arange(1, len(graph))))


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(axis=0)))


def _reachable(x: np.ndarray, graph: list[np.ndarray]) -> list[np.ndarray]:
    """Link whatever the medoid can't reach to its nearest reached row."""
    seen = np.zeros(len(x), bool)
    front = np.array([medoid(x)])
    while True:
        while len(front):
            seen[front] = True
            front = np.unique(np.concatenate([graph[i] for i in front]))
            front = front[~seen[front]]
        left = np.flatnonzero(~seen)
        if not len(left):
            return graph
        reached = np.flatnonzero(seen)
        to = reached[int(np.argmax(x[reached] @ x[left[0]]))]
        graph[to], graph[left[0]] = np.append(graph[to], left[0]), np.append(graph[left[0]], to)
        front = left[:1]


def search(x: np.ndarray, graph: np.ndarray, asked: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, row) found in range, a block of queries at a time. ``graph``: neighbours per row, padded with -1; both sides are unit vectors."""
    start, slack = medoid(x), threshold - 0.05
    near_to = [row[row >= 0] for row in graph]
    for at in range(0, len(asked), _BLOCK):
        q = asked[at:at + _BLOCK]
        n = len(q)
        seen = np.zeros((n, len(x)), bool)
        seen[:, start] = True
        beam = np.full((n, BEAM), -1)
        sim = np.full((n, BEAM), -2.0)
        done = np.ones((n, BEAM), bool)
        beam[:, 0], sim[:, 0], done[:, 0] = start, q @ x[start], False
        hits_q, hits_r = [np.flatnonzero(sim[:, 0] >= slack)], []
        hits_r.append(np.full(len(hits_q[0]), start))
        while True:
            open_ = np.where(done, -3.0, sim)
            best = np.argmax(open_, axis=1)
            who = np.flatnonzero(open_[np.arange(n), best] > -2)
            if not len(who):
                break
            done[who, best[who]] = True
            to = graph[beam[who, best[who]]]
            ok = (to >= 0) & ~seen[who[:, None], np.maximum(to, 0)]
            qi, k = np.nonzero(ok)
            new = to[qi, k]
            seen[who[qi], new] = True
            s = np.full(to.shape, -2.0)
            s[qi, k] = np.einsum("id,id->i", q[who[qi]], x[new])
            near = s[qi, k] >= slack
            hits_q.append(who[qi[near]])
            hits_r.append(new[near])
            both, both_sim = np.concatenate([beam[who], to], 1), np.concatenate([sim[who], s], 1)
            both_done = np.concatenate([done[who], ~ok], 1)
            keep = np.argsort(-both_sim, axis=1, kind="stable")[:, :BEAM]
            beam[who], sim[who], done[who] = (np.take_along_axis(z, keep, 1) for z in (both, both_sim, both_done))
        # everything in range is expanded, whether the beam held it or not
        front_q, front_r = np.concatenate(hits_q), np.concatenate(hits_r)
        found_q, found_r = [front_q], [front_r]
        unseen = ~seen.T
        while len(front_q):
            # row by row, for all queries at once that have it in front
            asks = np.zeros((len(x), n), bool)
            asks[front_r, front_q] = True
            reached = np.zeros((len(x), n), bool)
            for row in np.unique(front_r):
                reached[near_to[row]] |= asks[row]
            reached &= unseen
            unseen &= ~reached
            rows = np.flatnonzero(reached.any(axis=1))
            some = reached[rows]
            if 8 * some.sum() > some.size:  # most pairs of these rows: one product
                i, front_q = np.nonzero(some & (x[rows] @ q.T >= slack))
            else:
                i, front_q = np.nonzero(some)
                near = _in_range(q, front_q, x, rows[i], slack)
                i, front_q = i[near], front_q[near]
            front_r = rows[i]
            found_q.append(front_q)
            found_r.append(front_r)
        yield np.concatenate(found_q) + at, np.concatenate(found_r)


def _in_range(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether x[a[i]] . y[b[i]] reaches the threshold."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), _PAIRS):
        out[i:i + _PAIRS] = np.einsum("id,id->i", x[a[i:i + _PAIRS]], y[b[i:i + _PAIRS]]) >= threshold
    return out


class Links:
    """Symmetric links between the ``n`` rows of a task, a bit for each pair: 72 MB for two parts of ``PART_ROWS``, however many links."""

    def __init__(self, n: int):
        self.n, self.bits = n, np.zeros((n, -(-n // 8)), np.uint8)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        rows, at = np.unique(a, return_inverse=True)
        for i in range(0, len(rows), _BLOCK):
            mine = (at >= i) & (at < i + _BLOCK)
            block = np.zeros((min(_BLOCK, len(rows) - i), self.n), bool)
            block[at[mine] - i, b[mine]] = True
            self.bits[rows[i:i + _BLOCK]] |= np.packbits(block, axis=1, bitorder="little")

    def _rows(self, low: int, high: int) -> np.ndarray:
        return np.unpackbits(self.bits[low:high], axis=1, count=self.n, bitorder="little")

    def both_ways(self) -> None:
        for low in range(0, self.n, _BLOCK):
            self.bits[:, low // 8:(low + _BLOCK) // 8] |= np.packbits(self._rows(low, low + _BLOCK).T, axis=1, bitorder="little")

    def sums(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of each row's links and their number."""
        found, met = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for low in range(0, self.n, _BLOCK):
            rows = self._rows(low, low + _BLOCK)
            met[low:low + _BLOCK] = rows.sum(axis=1)
            i, j = np.nonzero(rows)
            np.add.at(found, low + i, weight[j])
        return found, met

    def forest(self) -> tuple[list[int], list[int]]:
        """A spanning forest: every row is taken up once, from the first linked row that is reached."""
        u, v, left = [], [], np.ones(self.n, bool)
        for root in np.flatnonzero(self.bits.any(axis=1)):
            front = [int(root)] if left[root] else []
            left[root] = False
            while front:
                row = front.pop()
                new = np.flatnonzero(left & self._rows(row, row + 1)[0].view(bool)).tolist()
                left[new] = False
                u += [row] * len(new)
                v += new
                front += new
        return u, v


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), float)


def _links(classes: DataFrame, threshold: float, dim: int, n: int, overlap: int) -> DataFrame:
    """``(rep, found, met, u, v)``: vectors and classes linked with each class beside its own, and forest edges."""
    spark = classes.sparkSession
    centres = kmeans(unit(sample_of(classes.withColumnRenamed("rep", "id"), dim)), max(1, min(MAX_CLUSTERS, n // CLUSTER_ROWS)))
    sent = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("array<long>")
    def clusters(vec: pd.Series) -> pd.Series:
        return pd.Series(list(nearest(unit(_matrix(vec)), sent.value, overlap)))

    placed = materialise(classes.withColumn("clusters", clusters("vec")), "graph-rows")
    nodes = placed.select("rep", "n", "vec", "clusters", F.explode("clusters").alias("cluster"))
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("c")).collect()  # at most MAX_CLUSTERS rows
    shape = spark.sparkContext.broadcast({r.cluster: -(-r.c // PART_ROWS) for r in sizes})

    @F.pandas_udf("long")
    def parts_of(cluster: pd.Series) -> pd.Series:
        return cluster.map(shape.value).astype(np.int64)

    nodes = nodes.withColumn("parts", parts_of("cluster")).withColumn("part", F.expr("pmod(xxhash64(rep), parts)"))

    def adjacency(pdf: pd.DataFrame) -> pd.DataFrame:
        rep = pdf["rep"].to_numpy(np.int64)
        return pd.DataFrame({"rep": rep, "near": [rep[g] for g in build_graph(unit(_matrix(pdf["vec"])))]})

    lists = nodes.groupBy("cluster", "part").applyInPandas(adjacency, "rep long, near array<long>")
    united = materialise(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")  # at most OVERLAP lists each

    # each pair of parts is a task
    indexed = nodes.join(united, "rep").withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).select(
        "cluster", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "rep", "n", "vec", "clusters", "near")

    def padded(node: pd.DataFrame) -> np.ndarray:
        """Neighbours within ``node`` (ascending rep), padded with -1."""
        rep = node["rep"].to_numpy(np.int64)
        own = np.repeat(np.arange(len(node)), [len(x) for x in node["near"]])
        to = np.concatenate([np.asarray(x, np.int64) for x in node["near"]]) if len(own) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(rep, to), len(rep) - 1)
        inside = rep[at] == to  # neighbours from the other shards' lists count where both are here
        own, at = own[inside], at[inside]
        width = np.bincount(own, minlength=len(rep))
        graph = np.full((len(rep), max(1, width.max(initial=0))), -1)
        graph[own, np.arange(len(own)) - (np.cumsum(width) - width)[own]] = at
        return graph

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        here, low, high = (int(pdf[c].iloc[0]) for c in ("cluster", "low", "high"))
        pdf = pdf.sort_values(["part", "rep"]).reset_index(drop=True)
        part, rep, weight = (pdf[c].to_numpy(np.int64) for c in ("part", "rep", "n"))
        raw = unit(_matrix(pdf["vec"]))
        home = np.array([c[0] for c in pdf["clusters"]], np.int64)
        width = int(home.max()) + 1
        lies = np.concatenate([i * width + np.asarray(c, np.int64)[np.asarray(c) < width] for i, c in enumerate(pdf["clusters"])])
        lies.sort()
        links = Links(len(pdf))
        for mine, other in {(low, high), (high, low)}:
            node, ask = np.flatnonzero(part == other), np.flatnonzero((part == mine) & (home >= here))
            if not len(node) or not len(ask):
                continue
            for q, r in search(raw[node], padded(pdf.iloc[node]), raw[ask], threshold):
                q, r = ask[q], node[r]
                ok = (q != r) & ((home[q] == here) | (home[r] == here))
                q, r = q[ok], r[ok]
                one, two = np.where(home[q] == here, q, r), np.where(home[q] == here, r, q)
                want = one * width + home[two]  # does the one lie in the other's home? Then the smaller home has the pair
                both = lies[np.minimum(np.searchsorted(lies, want), len(lies) - 1)] == want
                ok = ~(both & (home[two] < here))
                q, r = q[ok], r[ok]
                ok = _in_range(raw, q, raw, r, threshold)
                links.add(q[ok], r[ok])
        links.both_ways()
        found, met = links.sums(weight)
        hit = np.flatnonzero(met)
        u, v = (rep[x].tolist() for x in links.forest())
        none = [None] * len(hit)
        out = pd.DataFrame({"rep": pd.array(rep[hit], "Int64"), "found": found[hit], "met": met[hit], "u": pd.array(none, "Int64"), "v": pd.array(none, "Int64")})
        edges = pd.DataFrame({"rep": pd.array([None] * len(u), "Int64"), "found": 0, "met": 0, "u": pd.array(u, "Int64"), "v": pd.array(v, "Int64")})
        return pd.concat([out, edges], ignore_index=True)

    found = indexed.groupBy("cluster", "low", "high").applyInPandas(walk, "rep long, found long, met long, u long, v long")
    return materialise(found, "graph-links")


def _recall(classes: DataFrame, links: DataFrame, threshold: float) -> float | None:
    """Mean share of a class's links that was found, over audited classes that have one by brute force over all (none: null)."""
    spark, buckets = classes.sparkSession, -(-classes.count() // AUDITED)
    met = links.where("rep is not null").groupBy("rep").agg(F.sum("met").alias("met"))
    total, linked, at, width = 0.0, 0, 0, 1
    while linked < LINKED and at < -(-buckets // 20):
        audited = classes.where(F.expr(f"pmod(xxhash64(rep, 9), {buckets}) between {at} and {at + width - 1}")).select("rep", "vec").toPandas()
        at, width = at + width, min(4 * width, 16)
        if not len(audited):
            continue
        sent = spark.sparkContext.broadcast((audited["rep"].to_numpy(np.int64), unit(_matrix(audited["vec"]))))

        def count(batches, sent=sent):
            ids, asked = sent.value
            truth = np.zeros(len(ids), np.int64)
            for pdf in batches:
                for i in range(0, len(pdf), 1024):
                    x, rep = unit(_matrix(pdf["vec"].iloc[i:i + 1024])), pdf["rep"].to_numpy(np.int64)[i:i + 1024]
                    truth += ((asked @ x.T >= threshold) & (ids[:, None] != rep)).sum(axis=1)
            yield pd.DataFrame({"rep": ids, "truth": truth})

        truth = classes.select("rep", "vec").mapInPandas(count, "rep long, truth long").groupBy("rep").agg(F.sum("truth").alias("truth")).where("truth > 0")
        share = F.least("truth", F.coalesce("met", F.lit(0))) / F.col("truth")
        r = truth.join(met, "rep", "left").agg(F.sum(share), F.count("*")).first()
        total, linked = total + (r[0] or 0.0), linked + r[1]
    return total / linked if linked else None


def near_vectors(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept, audited_recall)`` per row; the recall is null where no audited class has a link."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = "size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x != 0)"
    rows = rows.withColumn("vec", F.expr(f"if({fine}, transform(vec, x -> x + 0D), null)"))
    classes = materialise(rows.where("vec is not null and id is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    links, recall = None, None
    for r in classes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():
        own = classes.where(F.size("vec") == r.dim)
        for overlap in (OVERLAP, 4 * OVERLAP, MAX_CLUSTERS):
            found = _links(own, threshold, r.dim, r.n, overlap)
            got = _recall(own, found, threshold)
            if got is None or got >= RECALL or overlap >= r.n // CLUSTER_ROWS:
                break
        if got is not None and got < LEAST_RECALL:
            raise RuntimeError(f"near vectors of {r.dim} components: audited recall {got:.3f} is below {LEAST_RECALL} at overlap {overlap}")
        recall = min((x for x in (recall, got) if x is not None), default=None)
        links = found if links is None else links.union(found)
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("double").alias("audited_recall"))
    groups = connected_components(links.where("u is not null").select("u", "v"))
    counts = links.where("rep is not null").groupBy("rep").agg(F.sum("found").alias("found"))
    of = classes.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("vec").alias("class"), (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(of, (F.col("vec") == F.col("class")) & F.col("id").isNotNull(), "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))).withColumn("audited_recall", F.lit(recall).cast("double"))
