"""Toxicity classifier: character n-grams scaled by naive Bayes log-count ratios, then a linear model.

A feature is the presence of a hashed character n-gram (3 to 5 characters,
whole text, lower-cased). Spark counts, per class, all labelled texts that
hold it; r = log of the ratio of its smoothed class frequencies scales the
feature, and features whose counts chance could explain (G squared below
``MIN_EVIDENCE``) are left out. A logistic
regression over the scaled features is fitted on the driver, from at most
``MAX_TRAIN`` labelled rows, as the features of each row. That sample may hold
the classes in other shares than the labels, so the intercept is moved by the
difference of the log-odds. Scoring is one pass
over the texts in which only the model (at most ``BUCKETS`` weights) is sent.

Null and empty texts have no features and get the model's prior. Without
labelled rows, or with one class only, every score is that class's share (0
without rows). Rows repeat as they come; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import drop_held, materialise, release

ORDERS = (3, 4, 5)
BUCKET_BITS = 21
BUCKETS = 1 << BUCKET_BITS
#: Labelled rows that the logistic fit uses at most: those with the smallest hash, half of it for either class.
MAX_TRAIN = 8_000
#: Labelled ids up to which they are broadcast to the texts; beyond it the labelled texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SMOOTHING = 1.0
#: Least log-likelihood ratio (G squared) of a feature's counts against equal shares in both classes.
MIN_EVIDENCE = 20.0
_SLICE = 1 << 19
_BLOCK = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _slice_buckets(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: bucket and owner of each n-gram that lies in one text."""
    h = codes.astype(np.uint64)
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            return
        h = h[:-1] * np.uint64(1_000_003) + codes[n - 1:]
        if n in ORDERS:
            whole = owner[:len(h)] == owner[n - 1:]
            bucket = ((h + np.uint64(n)) * _MULTIPLIER) >> np.uint64(64 - BUCKET_BITS)
            yield bucket[whole], owner[:len(h)][whole]


def ngram_buckets(texts: list[str | None], keep: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Distinct (text number, bucket) pairs as text * BUCKETS + bucket, ascending, some whole texts at a time; ``keep`` marks wanted buckets."""
    def distinct(parts: list[str], owners: list[int]) -> np.ndarray:
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.array(owners, np.int32), [len(p) for p in parts])
        got = [np.zeros(0, np.int64)]
        for b, o in _slice_buckets(codes, owner):
            if keep is not None:
                k = np.flatnonzero(keep[b])
                b, o = b[k], o[k]
            got.append(o.astype(np.int64) << BUCKET_BITS | b.astype(np.int64))
        return np.unique(np.concatenate(got))

    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        if len(text) > _SLICE:  # slices of a long text overlap, so that no n-gram is lost
            if parts:  # the texts before it come first
                yield distinct(parts, owners)
                parts, owners, size = [], [], 0
            step = _SLICE - max(ORDERS) + 1
            found = np.zeros(0, np.int64)
            for at in range(0, len(text), step):
                found = np.union1d(found, distinct([text[at:at + _SLICE]], [i]))
            yield found
        elif text:
            parts.append(text)
            owners.append(i)
            size += len(text)
            if size >= _SLICE:
                yield distinct(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        yield distinct(parts, owners)


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  #: ascending
    weights: np.ndarray  #: linear weight times log-count ratio
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        keep = np.zeros(BUCKETS, bool)
        keep[self.buckets] = True
        z = np.full(len(texts), self.bias)
        for found in ngram_buckets(texts, keep):
            if len(found):
                weight = self.weights[np.searchsorted(self.buckets, found & (BUCKETS - 1))]
                z += np.bincount(found >> BUCKET_BITS, weight, len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logistic(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, penalty: float = 0.02, rounds: int = 200) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on sparse rows of scaled features, by Adam."""
    sizes = np.array([len(x) for x in rows], np.int64)
    block = np.cumsum(sizes) // _BLOCK  # some rows at a time: only their features' numbers are held for all
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(rows)]
    blocks = [(a, b, np.concatenate(rows[a:b])) for a, b in zip(cuts, cuts[1:]) if sizes[a:b].any()]
    rows.clear()
    w, b = np.zeros(len(r) + 1), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        e, g = np.empty(len(y)), np.zeros(len(r) + 1)
        e[:] = 1 / (1 + np.exp(-np.clip(w[-1], -500, 500))) - y  # rows without features
        for i, j, index in blocks:
            owner, value = np.repeat(np.arange(j - i), sizes[i:j]), r[index]
            z = w[-1] + np.bincount(owner, value * w[index], j - i)
            e[i:j] = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[i:j]
            g[:-1] += np.bincount(index, value * e[i:j][owner], len(r))
        g[-1] = e.sum()
        g /= len(y)
        g[:-1] += penalty * w[:-1] / len(r)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", max_train: int = MAX_TRAIN) -> Model:
    """Fit on the texts of ``docs`` whose ids have a 0/1 label in ``labels``.

    The bounded sample of the logistic fit is chosen among the labelled ids, so at most ``max_train``
    small rows are broadcast for it and no text is shuffled but theirs. The n-grams of all labelled texts are counted where they lie.
    """
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    rows = rows.groupBy("id").agg(F.max("y").alias("y")).join(ids, "id", "left_semi").withColumn("h", F.xxhash64("id"))
    rows = materialise(rows, "labelled-ids")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        share = 1.0 if 1 in n else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), 500.0 if share else -500.0)
    half = max_train // 2
    parts = [rows.where(F.col("y") == y).orderBy("h", "id").limit(min(n[y], max(half, max_train - n[1 - y]))) for y in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(chosen, "id").select("text", "y", "h")
    sample = materialise(sample.repartition(2 * max(1, docs.sparkSession.sparkContext.defaultParallelism)), "labelled-texts")
    total = sum(n.values())
    if total <= max_train:  # the sample is all of them
        return _fit_sample(sample, _class_counts(sample))
    small = rows.select("id", "y")
    return _fit_sample(sample, _class_counts(texts.join(F.broadcast(small) if total <= BROADCAST_IDS else small, "id").select("text", "y")))


def _class_counts(labelled: DataFrame) -> DataFrame:
    """``(bucket, p, q)``: texts of class 1 and of class 0 that hold the bucket; bucket -1: all texts."""
    def texts_with(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_held()
        count, rows = np.zeros(2 * BUCKETS, np.int32), np.zeros(2, np.int64)
        for pdf in batches:
            y = pdf["y"].to_numpy(np.int64)
            rows += np.bincount(y, minlength=2)
            for found in ngram_buckets(pdf["text"].tolist()):
                key, n = np.unique((found & (BUCKETS - 1)) * 2 + y[found >> BUCKET_BITS], return_counts=True)
                count[key] += n.astype(np.int32)
            release()
        yield pd.DataFrame({"bucket": [-1], "p": rows[1:], "q": rows[:1]})
        count = count.reshape(-1, 2)
        held = np.flatnonzero(count.any(axis=1))
        for at in range(0, len(held), _SLICE):
            key = held[at:at + _SLICE]
            yield pd.DataFrame({"bucket": key, "p": count[key, 1].astype(np.int64), "q": count[key, 0].astype(np.int64)})

    counts = labelled.mapInPandas(texts_with, "bucket long, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return materialise(counts, "class-counts")


def _fit_sample(sample: DataFrame, counts: DataFrame) -> Model:
    """Features and their ratios from ``counts`` of all labelled texts, weights from ``sample``."""
    total = counts.where("bucket = -1").first()
    n0, n1 = float(total.q), float(total.p)
    share = n1 / (n0 + n1)
    evidence = "2 * (if(p > 0, p * ln(p / ((p + q) * {0}D)), 0D) + if(q > 0, q * ln(q / ((p + q) * {1}D)), 0D))".format(share, 1 - share)
    chosen = counts.where(f"bucket >= 0 and {evidence} >= {MIN_EVIDENCE}").select(
        "bucket", F.expr(f"ln((p + {SMOOTHING}D) / ({n1}D + 2 * {SMOOTHING}D)) - ln((q + {SMOOTHING}D) / ({n0}D + 2 * {SMOOTHING}D))").alias("r"))
    chosen = chosen.toPandas().sort_values("bucket")
    buckets, r = chosen["bucket"].to_numpy(np.int64), chosen["r"].to_numpy(float)
    keep = np.zeros(BUCKETS, bool)
    keep[buckets] = True
    sent = sample.sparkSession.sparkContext.broadcast(np.packbits(keep))

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_held()
        wanted = np.unpackbits(sent.value, count=BUCKETS).astype(bool)
        for pdf in batches:
            found = np.concatenate([np.zeros(0, np.int64), *ngram_buckets(pdf["text"].tolist(), wanted)])
            cuts = np.searchsorted(found >> BUCKET_BITS, np.arange(len(pdf) + 1))
            yield pd.DataFrame({"y": pdf["y"], "h": pdf["h"], "found": [(found[a:b] & (BUCKETS - 1)).astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:])]})

    got = materialise(sample.mapInPandas(rows_of, "y int, h long, found binary"), "sample-features")
    sent.destroy()
    found = []  # a partition at a time: the driver holds each row's features once
    for row in got.toLocalIterator():
        found.append((row.h, row.y, crc32(row.found), np.searchsorted(buckets, np.frombuffer(row.found, "<i4")).astype(np.int32)))
    found.sort(key=lambda x: x[:3])
    y, rows = np.array([x[1] for x in found], float), [x[3] for x in found]
    found.clear()
    w, bias = _logistic(rows, r, y)
    s1 = y.sum()
    return Model(buckets, w * r, bias + float(np.log(n1 / n0) - np.log(s1 / (len(y) - s1))))


def score_column(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Probability of the label 1 for each text of ``df``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        drop_held()
        for texts in batches:
            yield pd.Series(sent.value.score(texts.tolist()))
            release()

    return score(F.col(text_col))
