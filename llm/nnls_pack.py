"""Packing by non-negative least squares over shallow length combinations.

Documents are encoded (``llm.bpe``) with an end id each and cut into pieces
of the window's size and a rest. Piece lengths are counted in ``BUCKETS``
steps (rounded up, so a plan always fits). All combinations of up to
``DEPTH`` steps that fill the window exactly are the columns of a
non-negative least-squares problem whose right side is the histogram; its
solution, rounded down, says how often each combination is used, and what
is left is packed greedily, largest first, again on the histogram. The
plan's size depends on ``BUCKETS`` alone, so the driver sees a histogram
and never a piece.

Pieces get their place by rank: a piece's rank within its step (salted, by
hash, so that no step is one task) decides on combination, repeat and slot,
and a window over each sequence gives the offsets. Ties are broken by all
columns, so rows that still tie are alike.

Null and empty texts are a lone end id. Repeated rows are documents of their
own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.bpe import as_bytes, char_runs
from llm.common import materialise, release

WINDOW = 2048
BUCKETS = 256
DEPTH = 3
#: Pieces of one step that a task ranks, about.
RANKED = 20_000

Plan = list[tuple[tuple[int, ...], int]]


def pieces(df: DataFrame, source: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens)``: a row per piece of each document."""
    sent = df.sparkSession.sparkContext.broadcast(source)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, end = as_bytes(sent.value), np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            texts, owners, rows = pdf["text"].tolist(), [], []
            for part in char_runs(texts):
                for i, encoded in enumerate(bpe.encode_texts(texts[part]), part.start):
                    ids = memoryview(encoded + end)
                    total = len(ids) // 4
                    for at in range(0, total, window):
                        piece = ids[4 * at:4 * (at + window)]
                        owners.append(i)
                        rows.append((at, len(piece) // 4, crc32(piece), total))
            out = pd.DataFrame(rows, columns=["start", "length", "ids_crc32", "doc_tokens"])
            out.insert(0, "id", pdf["id"].iloc[owners].to_numpy())
            yield out
            release()
        bpe.settle()

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(steps: list[int], total: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Descending combinations of up to ``depth`` of the steps that sum to ``total``."""
    here, out = set(steps), []

    def extend(chosen: tuple[int, ...], left: int, most: int) -> None:
        if left in here and left <= most:
            out.append((*chosen, left))
        if len(chosen) + 2 <= depth:
            for s in steps:
                if s <= most and s < left:
                    extend((*chosen, s), left - s, s)

    extend((), total, total)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """The non-negative x with the least |ax - b|, by the active-set method."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(b).max(initial=0))
    for _ in range(rounds or 3 * max(a.shape)):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient)) if n else 0
        if not n or gradient[best] <= tolerance:
            break
        active[best] = True
        while True:
            chosen = np.flatnonzero(active)
            part = a[:, chosen]
            gram = part.T @ part
            z = np.linalg.solve(gram + 1e-9 * np.eye(len(chosen)), part.T @ b)
            if (z > 1e-12).all():
                x[:] = 0
                x[chosen] = z
                break
            low = z <= 1e-12
            gap = x[chosen][low] - z[low]
            step = np.min(np.divide(x[chosen][low], gap, out=np.zeros_like(gap), where=gap > 0))
            x[chosen] += step * (z - x[chosen])
            drop = chosen[x[chosen] <= 1e-12]
            active[drop if len(drop) else chosen[low]] = False
            x[~active] = 0
    return x


def plan_of(histogram: dict[int, int], total: int = BUCKETS, depth: int = DEPTH) -> Plan:
    """Combinations and how often each is used; together they use every count of ``histogram`` {step: pieces}."""
    left = np.zeros(total + 1, np.int64)
    for step, n in histogram.items():
        left[step] = n
    plan: Plan = []

    def use(parts: tuple[int, ...], most: int | None = None) -> None:
        step, times = np.unique(parts, return_counts=True)
        n = int(np.min(left[step] // times))
        n = n if most is None else min(n, most)
        if n:
            left[step] -= n * times
            plan.append((parts, n))

    use((total,))
    steps = [int(s) for s in np.flatnonzero(left)]
    columns = combinations(steps, total, depth)
    if columns:
        a = np.zeros((total + 1, len(columns)))
        for k, parts in enumerate(columns):
            np.add.at(a[:, k], list(parts), 1)
        x = nnls(a[steps], left[steps].astype(float))
        for k in np.argsort(-x, kind="stable"):
            if x[k] >= 1:
                use(columns[k], int(x[k]))
    while left.any():
        parts, room, rest = [], total, left.copy()
        while True:
            fits = np.flatnonzero(rest[:room + 1])
            if not len(fits):
                break
            parts.append(int(fits[-1]))
            rest[fits[-1]] -= 1
            room -= int(fits[-1])
        use(tuple(parts))
    return plan


def _slots(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per step, in rank order: first rank, first sequence and slot of each run of places."""
    firsts = [0, *accumulate(n for _, n in plan)]
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    for (parts, n), first in zip(plan, firsts):
        for slot, step in enumerate(parts):
            runs.setdefault(step, []).append((ranks.get(step, 0), first, slot))
            ranks[step] = ranks.get(step, 0) + n
    return {step: tuple(np.array(x, np.int64) for x in zip(*rows)) for step, rows in runs.items()}


def pack(df: DataFrame, source: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = df.sparkSession
    step = max(1, window // BUCKETS)
    found = materialise(pieces(df, source, end_id, window, id_col, text_col), "pieces")
    found = found.withColumn("step", F.expr(f"cast(ceil(length / {step}) as int)"))
    histogram = {r.step: r.n for r in found.groupBy("step").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan_of(histogram, -(-window // step)))
    salts = max(1, -(-max(histogram.values(), default=1) // RANKED))
    salted = found.withColumn("salt", F.expr(f"pmod(xxhash64(id, start, ids_crc32), {salts})"))
    before = salted.groupBy("step", "salt").agg(F.count("*").alias("n")).select(
        "step", "salt", (F.sum("n").over(Window.partitionBy("step").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("step", "salt").orderBy("id", "start", "length", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("rank", F.row_number().over(order)).join(before, ["step", "salt"]).withColumn(
        "rank", F.col("rank") - 1 + F.col("before"))
    sent = spark.sparkContext.broadcast(slots)

    @F.pandas_udf("sequence_id long, slot int")
    def place(steps: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        s, r = steps.to_numpy(), ranks.to_numpy()
        sequence, slot = np.zeros(len(s), np.int64), np.zeros(len(s), np.int32)
        for one in np.unique(s):
            here = s == one
            first_rank, first, slots_ = sent.value[one]
            at = np.searchsorted(first_rank, r[here], "right") - 1
            sequence[here] = first[at] + r[here] - first_rank[at]
            slot[here] = slots_[at]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    placed = ranked.withColumn("p", place("step", "rank")).select("id", "start", "length", "ids_crc32", "doc_tokens", "p.sequence_id", "p.slot")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))
