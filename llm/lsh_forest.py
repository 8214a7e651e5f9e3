"""Near-duplicate groups by an LSH forest over MinHash signatures.

A document's set holds the distinct shingles of ``width`` words (ASCII
letters lower-cased; with fewer words, the whole sequence). Documents with
equal sets are one class. Each class has ``TREES`` signature orders of
``DEPTH`` MinHash values; every order is sorted over the cluster by range
partitioning, and depth adapts per region. Where at most ``RUN`` classes
share the first ``SHARED`` values, all of them are compared. Where more do,
a class meets the ``REACH`` next ones, which are those with the longest
common prefixes, and is noted as dense. The rows at partition borders are
compared in a second, small pass. No group is ever gathered: copies are
spread by the sort.

Candidates with sketches far apart are left out (``SLACK``; a pair at the
threshold is over four standard deviations away from it). The rest is
confirmed on full sets: each class with its most similar neighbour first,
then whatever still joins different groups. Dense classes of different
groups are then finished exactly, whatever their number (``dense_pairs``):
shingles that one group alone holds can't join two, so a class with fewer
than threshold * size others is done, and the rest meet by a prefix filter on
their rarest common shingles. Links with 100 * intersection >= 100 *
threshold * union stay. A pair at a threshold of 0.8 or more that shares fewer
than ``SHARED`` first values in all orders is missed (4 in 100,000 at 0.8).

Null and empty texts have empty sets and link with nothing. Rows repeat as
they come and get the same result; ids may not be null in links, so rows
with a null id only keep their own result. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import SLICE, drop_held, materialise, mix, release, row_slices, text_buffers, word_hashes
from llm.components import connected_components

TREES = 10
DEPTH = 7
#: First values of an order that make a run, and the classes in a run up to which all are compared.
SHARED, RUN = 2, 32
#: Followers in a sorted order that a class of a longer run is compared with; the exact pass does the rest.
REACH = 4
#: Parity bits of a set in the exact pass: 256 bytes, telling for sets of up to about 2,000 shingles.
BITS = 2048
#: A pair is dropped unconfirmed if this share of the threshold's sketch matches is missing.
SLACK = 0.20
#: Classes in candidate pairs up to which their ids are broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_K = TREES * DEPTH
_SEEDS = mix(np.arange(1, _K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(column, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    buf, offsets = text_buffers(column)
    for low, high in row_slices(offsets, SLICE):
        base = offsets[low]
        words, first = word_hashes(buf[base:offsets[high]], offsets[low:high + 1] - base)
        for i in range(high - low):
            w = words[first[i]:first[i + 1]]
            n = len(w) - width + 1
            if n < 1 and len(w):
                h = w[:1] * np.uint64(0) + np.uint64(len(w))
                for x in w:
                    h = mix(h * np.uint64(3) + x)
                yield h
            elif n < 1:
                yield np.zeros(0, np.uint64)
            else:
                h = w[:n]
                for k in range(1, width):
                    h = mix(h * np.uint64(3) + w[k:k + n])
                yield np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` MinHash values of 32 bits."""
    out = np.full(_K, 2**32 - 1, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = shingles.astype(np.uint32)
    for at in range(0, len(shingles), 4096):
        h = low[None, at:at + 4096] ^ _SEEDS[:, None].astype(np.uint32)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h += high[None, at:at + 4096]
        h *= (_SEEDS[:, None] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, d1, d2, n, sig)``: digest of the set, its size, and its signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            digests, sizes, sigs = [], [], []
            for s in shingle_sets(batch.column(1), width):
                sizes.append(len(s))
                odd = mix(s + np.uint64(0x51ED27)) if len(s) else s
                digests.append((int(s.sum(dtype=np.uint64)), int(odd.sum(dtype=np.uint64))))
                sigs.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            d = np.array(digests, np.uint64).reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())],
                names=["id", "d1", "d2", "n", "sig"])
            release()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, d1 long, d2 long, n long, sig binary")


def _pairs(keys: list[bytes], reps: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[list, list, list]:
    """Candidates among rows in sorted order: (a, b, matching sketch bytes); (a, a, 0) for a class in a long run."""
    a, b, est = [], [], []
    n = len(keys)
    k = np.frombuffer(b"".join(keys), np.uint8).reshape(n, -1)
    least = int(_K * (threshold - SLACK))

    def runs(values: int) -> np.ndarray:
        """A number per row, the same for rows of one order with that many equal first values."""
        cut = 1 + 4 * values
        return np.concatenate([[0], np.cumsum((k[1:, :cut] != k[:-1, :cut]).any(axis=1))])

    one, run = runs(1), runs(SHARED)
    edges = np.zeros(n + 1, np.int64)
    if n > RUN:  # each stretch of RUN + 1 rows of one run is dense
        begins = np.flatnonzero(run[:-RUN] == run[RUN:])
        np.add.at(edges, begins, 1)
        np.add.at(edges, begins + RUN + 1, -1)
    dense = np.cumsum(edges)[:n] > 0
    if dense.any():
        ids = np.unique(reps[dense])
        a.append(ids)
        b.append(ids)
        est.append(np.zeros(len(ids), np.int64))
    for j in range(1, min(RUN, n)):
        if j <= REACH:
            rows = np.flatnonzero(one[:-j] == one[j:])
        else:
            rows = np.flatnonzero(~dense[:-j] & (run[:-j] == run[j:]))
            if not len(rows):
                break
        small, large = np.minimum(sizes[rows], sizes[rows + j]), np.maximum(sizes[rows], sizes[rows + j])
        rows = rows[(reps[rows] != reps[rows + j]) & (small >= threshold * large)]
        match = (sketch[rows] == sketch[rows + j]).sum(axis=1)
        rows, match = rows[match >= least], match[match >= least]
        a.append(np.minimum(reps[rows], reps[rows + j]))
        b.append(np.maximum(reps[rows], reps[rows + j]))
        est.append(match)
    return a, b, est


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, est)`` from the sorted orders of ``classes (rep, n, sig)``; ``a = b`` for dense classes."""
    spark = classes.sparkSession
    rows = classes.count()
    width = 4 * DEPTH

    def orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), _K, 4) if len(pdf) else np.zeros((0, _K, 4), np.uint8)
            sketch = [bytes(x) for x in sig[:, :, 3]]
            for t in range(TREES):
                keys = [bytes([t]) + x.tobytes() for x in np.ascontiguousarray(sig[:, t * DEPTH:(t + 1) * DEPTH])]
                yield pd.DataFrame({"key": keys, "rep": pdf["rep"], "n": pdf["n"], "sketch": sketch})

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * TREES // 2000))
    forest = classes.select("rep", "n", "sig").mapInPandas(orders, "key binary, rep long, n long, sketch binary")
    forest = forest.repartitionByRange(parts, "key", "rep").sortWithinPartitions("key", "rep")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        left: pd.DataFrame | None = None
        began = False
        for pdf in batches:
            if not len(pdf):
                continue
            if not began:  # the first rows also meet the last ones of the partition before
                yield _border(pdf.head(RUN), part - 1, 1)
                began = True
            both = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            yield _found(both, threshold)
            left = both.tail(RUN)
        if left is not None:
            yield _border(left, part, 0)

    schema = "a long, b long, est int, border int, side int, key binary, rep long, n long, sketch binary"
    met = materialise(forest.mapInPandas(walk, schema), "forest")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "key", "rep"]).reset_index(drop=True)
        return _found(pdf, threshold)[["a", "b", "est"]]

    border = met.where("border is not null").groupBy("border").applyInPandas(
        lambda pdf: across(pdf), "a long, b long, est int")
    return met.where("border is null").select("a", "b", "est").union(border).distinct()


_NAMES = ["a", "b", "est", "border", "side", "key", "rep", "n", "sketch"]


def _border(rows: pd.DataFrame, border: int, side: int) -> pd.DataFrame:
    out = rows[["key", "rep", "n", "sketch"]].copy()
    out["border"], out["side"] = border, side
    return out.reindex(columns=_NAMES).astype({"a": "Int64", "b": "Int64", "est": "Int32"})


def _found(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
    a, b, est = _pairs(rows["key"].tolist(), rows["rep"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), sketch, threshold)
    out = pd.DataFrame({"a": np.concatenate(a) if a else [], "b": np.concatenate(b) if b else [], "est": np.concatenate(est) if est else []})
    out = out.astype({"a": "Int64", "b": "Int64", "est": "Int32"}).drop_duplicates(["a", "b"])
    return out.reindex(columns=_NAMES).astype({"border": "Int32", "side": "Int32", "rep": "Int64", "n": "Int64"})


def _sets_of(docs: DataFrame, needed: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(rep, shingles)`` of the classes that candidate pairs name, from one copy each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets(batch.column(1), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["rep", "shingles"])
            release()

    picked = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    if needed.count() <= BROADCAST_IDS:
        return picked.join(F.broadcast(needed), "rep", "left_semi").mapInArrow(run, "rep long, shingles binary")
    return picked.mapInArrow(run, "rep long, shingles binary").join(needed, "rep", "left_semi")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the threshold."""
    percent = round(100 * threshold)

    @F.pandas_udf("boolean")
    def near(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return joined.where(near("x", "y")).select("a", "b")


def dense_pairs(dense: DataFrame, groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs ``(a, b)`` of ``dense (rep)`` classes in different groups that may reach the threshold.

    A prefix filter: of two sets that reach it, each one's first size - ceil(threshold * size) + 1 shingles in a
    common order share one. The order has shingles of one group first, then rare ones. Nothing is capped; a
    shingle's holders meet in a shuffled join, where AQE splits a hot one. The join's condition bounds the overlap
    by sizes, by places in the order, and by parity bits of the sets (``BITS``): sets differ in at least as many
    shingles as their parities differ in bits, so that no true pair is lost.
    """
    percent = round(100 * threshold)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                for at in range(0, len(held), 1 << 17):
                    part = held[at:at + (1 << 17)]
                    same = lambda c: pa.array(np.full(len(part), batch.column(c)[i].as_py(), np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [same(0), same(2), same(3), pa.array(np.full(len(part), len(held), np.int64)), pa.array(part)],
                        names=["rep", "g", "k", "n", "s"])

    @F.pandas_udf("array<long>")
    def parities(held: pd.Series) -> pd.Series:
        odd = [np.bincount(np.frombuffer(x, np.uint64) % np.uint64(BITS), minlength=BITS).astype(np.uint8) & 1 for x in held]
        return pd.Series([np.packbits(x).view(np.int64) for x in odd], dtype=object)

    own = dense.join(groups.toDF("rep", "component"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("g"))
    rows = sets.join(own, "rep").select("rep", "shingles", "g", F.xxhash64("shingles").alias("k"))
    rows = rows.mapInArrow(spread, "rep long, g long, k long, n long, s long")
    joining = materialise(
        rows.groupBy("s").agg(F.count("*").alias("f"), F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("s", "f"), "joining")
    found = materialise(rows.join(joining, "s"), "held")
    need = F.expr(f"cast(ceil({percent} * n / 100.0) as long)")
    enough = found.groupBy("rep", "k").agg(F.count("*").alias("m"), F.max("n").alias("n")).where(F.col("m") >= need)
    order = Window.partitionBy("rep", "k").orderBy("f", "s")
    marked = sets.withColumn("k", F.xxhash64("shingles")).join(enough.select("rep", "k", "m"), ["rep", "k"])
    marked = marked.select("rep", "k", "m", parities("shingles").alias("odd"))
    first = found.join(marked, ["rep", "k"]).withColumn("i", F.row_number().over(order))
    # n - m shingles come before the first joining one
    first = materialise(first.withColumn("i", F.expr("i + n - m")).where(F.col("i") <= F.expr("n + 1") - need).select("s", "rep", "g", "n", "i", "odd"), "prefix")
    x, y = first.toDF("s", "a", "ga", "na", "ia", "oa"), first.toDF("s", "b", "gb", "nb", "ib", "ob")
    met = x.join(y, "s").where("a < b and ga <> gb")
    # sizes and places leave room for the overlap that the threshold asks for
    met = met.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    met = met.where(f"(100 + {percent}) * (1 + least(na - ia, nb - ib) + least(ia, ib) - 1) >= {percent} * (na + nb)")
    differ = "aggregate(zip_with(oa, ob, (p, q) -> bit_count(p ^ q)), 0, (n, c) -> n + c)"
    met = met.where(f"(100 + {percent}) * (na + nb - {differ}) >= 2 * {percent} * (na + nb)")
    return met.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` per row: group by links, kept is its smallest id."""
    found = materialise(signatures(docs, width, id_col, text_col), "signatures")
    classes = found.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    classes = materialise(classes, "classes")
    # an id that two different texts share stands for both: the sets are told apart by the class
    met = materialise(candidates(classes, threshold), "pairs")
    pairs, dense = met.where("a < b"), met.where("a = b").select(F.col("a").alias("rep"))
    needed = materialise(met.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "needed")
    sets = materialise(_sets_of(docs, needed, width, id_col, text_col).dropDuplicates(["rep", "shingles"]), "sets")

    # round 1: each class with its most similar neighbour
    ends = pairs.selectExpr("inline(array(struct(a as x, b as y, est), struct(b as x, a as y, est)))")
    best = ends.groupBy("x").agg(F.max(F.struct("est", "y")).alias("m")).select(
        F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct()
    links = materialise(confirm(best, sets, threshold), "links")
    groups = connected_components(links.toDF("u", "v"))
    # round 2: what could still join two groups
    group = lambda c: groups.toDF(c, f"g{c}")
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(group("a"), "a", "left").join(group("b"), "b", "left")
    rest = rest.where("not (coalesce(ga, a) <=> coalesce(gb, b))").select("a", "b")
    links = links.union(materialise(confirm(rest, sets, threshold), "links"))
    groups = connected_components(links.toDF("u", "v"))
    # round 3: dense classes, exactly
    if not dense.isEmpty():
        more = materialise(confirm(dense_pairs(dense, groups, sets, threshold), sets, threshold), "links")
        if not more.isEmpty():
            groups = connected_components(links.union(more).toDF("u", "v"))

    group_of = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    # an empty set has no class: the row is its own group
    own = found.where("n > 0").join(group_of, ["d1", "d2", "n"], "left").union(
        found.where("n = 0").select("d1", "d2", "n", "id", "sig", F.lit(None).cast("long").alias("component")))
    out = own.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
