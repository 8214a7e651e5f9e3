"""Packed token-id output: best-fit-decreasing with a segment tree over capacities.

Texts are encoded (``llm.bpe``), each followed by an end id; a document
longer than the window is split losslessly into pieces of the window's
size and a rest. Pieces are packed in blocks of about ``BLOCK_TOKENS``
tokens, each within one input partition, so that no token id is shuffled
and memory is bounded: pieces in decreasing length go to the open sequence
with the least capacity that holds them, found by a segment tree over
capacities. A row per sequence holds the id matrix row (little-endian
unsigned 16-bit ids, 32-bit if the vocabulary needs it, padded with
``pad_id``), the cumulative segment lengths, the positions at which position
ids start again at 0, and each segment's document and start.

``write`` stores that as Parquet files through Spark's committer (a task that
runs twice leaves one file), ``read`` reads it back, and ``segments`` cuts the
matrix rows into the documents' pieces again.

Null and empty texts are a lone end id. Every row is a document, repeated
ones too. An empty table gives no sequences. A document longer than a
block makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe import as_bytes, char_runs

WINDOW = 2048
BLOCK_TOKENS = 4 << 20


class CapacityTree:
    """How many open bins have each capacity; finds the least capacity of at least a given one."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (bin, capacity) with the smallest capacity >= least."""
        count, node = self.count, self.leaves + least
        if not count[node]:
            while node > 1 and not (node % 2 == 0 and count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return self.bins[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Bins as lists of item numbers; every length is between 1 and the window."""
    tree, bins = CapacityTree(window), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = tree.take(lengths[item])
        if got is None:
            bins.append([item])
            left = window - lengths[item]
            number = len(bins) - 1
        else:
            number, capacity = got
            bins[number].append(item)
            left = capacity - lengths[item]
        if left:
            tree.add(left, number)
    return bins


def split_lengths(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    return [(at, min(window, n - at)) for at in range(0, n, window)]


def pack(df: DataFrame, source: str, end_id: int, window: int = WINDOW, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed sequence: ``sequence_id, n_tokens, ids, cu_seqlens, position_resets, docs, starts``."""
    sent = df.sparkSession.sparkContext.broadcast(source)
    id_type = df.schema[id_col].dataType.simpleString()

    def rows(block: list[tuple[object, bytes]], first: int, kind: str) -> pd.DataFrame:
        pieces = [(doc, at, ids[4 * at:4 * (at + n)]) for doc, ids in block for at, n in split_lengths(len(ids) // 4, window)]
        out, pad = [], np.array([pad_id], kind).tobytes()
        sizes = [len(p[2]) // 4 for p in pieces]
        for k, items in enumerate(best_fit_decreasing(sizes, window)):
            ids = np.frombuffer(b"".join([pieces[i][2] for i in items]), "<u4")
            cuts = [0, *accumulate([sizes[i] for i in items])]
            out.append((first + k, len(ids), ids.astype(kind).tobytes() + pad * (window - len(ids)), cuts, cuts[:-1],
                        [pieces[i][0] for i in items], [pieces[i][1] for i in items]))
        return pd.DataFrame(out, columns=["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "docs", "starts"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bpe = as_bytes(sent.value)
        kind = "<u2" if max(max(bpe.strings), end_id, pad_id) < 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        first, block, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33, [], 0
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["id"].tolist()
            for part in char_runs(texts):
                for doc, encoded in zip(ids[part], bpe.encode_texts(texts[part])):
                    block.append((doc, encoded + end))
                    size += len(block[-1][1]) // 4
                    if size >= BLOCK_TOKENS:
                        yield (out := rows(block, first, kind))
                        first, block, size = first + len(out), [], 0
        if block:
            yield rows(block, first, kind)
        bpe.settle()

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(run, f"sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, docs array<{id_type}>, starts array<long>")


def write(packed: DataFrame, path: str) -> None:
    """Store packed sequences below ``path``; every task writes its own blocks, nothing is shuffled."""
    packed.write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The packed sequences that ``write`` stored."""
    return spark.read.parquet(path)


def segments(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc, start, length, sequence_id, position, ids)``: a row per piece, its ids as bytes of the matrix's width."""
    cut = f"""inline(transform(docs, (d, i) -> named_struct('doc', d, 'start', starts[i], 'length', cu_seqlens[i + 1] - cu_seqlens[i],
        'sequence_id', sequence_id, 'position', cu_seqlens[i],
        'ids', substring(ids, 1 + cu_seqlens[i] * (length(ids) div {window}), (cu_seqlens[i + 1] - cu_seqlens[i]) * (length(ids) div {window})))))"""
    return packed.selectExpr(cut)
