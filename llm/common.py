"""Helpers shared by the operators: shared-folder tables and word hashing over Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.session import scratch_path

#: Bytes of text that one vectorised pass looks at; longer text is cut at white space.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _odd(x: int) -> int:
    return (x | 1) & (2**64 - 1)


def _letters() -> np.ndarray:
    table = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, np.uint64)
    table[65:91] = table[97:123]  # A-Z count as a-z
    return table


_TABLE = _letters()
_BASE = _odd(0x9E3779B97F4A7C15)
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _IPOW = _powers(_BASE, SLICE), _powers(_INVERSE, SLICE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Spark removes a query's shuffle files when the query ends, not when the driver collects garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: How to drop what an operator keeps in a worker process from one of its tasks to the next.
_HELD: list[Callable[[], None]] = []


def hold(drop: Callable[[], None]) -> None:
    """An operator keeps something in its worker processes; ``drop`` forgets it."""
    _HELD.append(drop)


def drop_held() -> None:
    """At the start of a task that needs none of it: Spark gives the same process to tasks of later stages."""
    for drop in _HELD:
        drop()
    release()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here.

    Nothing reads the written query's shuffles again, so they are cleaned up with it where Spark can.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEAN_UP, None)  # None: not set, Spark's default holds
    can = spark.conf.isModifiable(_CLEAN_UP)
    if can:
        spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if can and before is None:
            spark.conf.unset(_CLEAN_UP)
        elif can:
            spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote, once a later table holds all that is still needed of it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder_of_crc(column: str, modulus: int):
    """crc32 of an id as text, modulo ``modulus`` (a null id: remainder of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow text column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0]:offsets[-1]], offsets - offsets[0]


def _cut(buf: np.ndarray, offsets: np.ndarray, start: int, end: int) -> int:
    """The last place in (start, end] where no word is cut, or else the first one after ``end``."""
    inside = offsets[np.searchsorted(offsets, start, "right"):np.searchsorted(offsets, end, "right")]
    spaces = np.flatnonzero(_SPACE[buf[start:end]])
    best = max(inside[-1] if len(inside) else start, start + spaces[-1] + 1 if len(spaces) else start)
    if best > start:
        return int(best)
    stop = int(offsets[np.searchsorted(offsets, end, "right")])
    while end < stop:
        spaces = np.flatnonzero(_SPACE[buf[end:min(end + SLICE, stop)]])
        if len(spaces):
            return int(end + spaces[0])
        end = min(end + SLICE, stop)
    return stop


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space, A-Z lower-cased) of all texts,
    in order, and n + 1 indices: text i has the words from first[i] to first[i + 1]."""
    hashes, places, start, total = [], [], 0, len(buf)
    while start < total:
        end = min(start + SLICE, total)
        if end < total:
            end = _cut(buf, offsets, start, end)
        a = buf[start:end]
        power, inverse = (_POW, _IPOW) if len(a) <= SLICE else (_powers(_BASE, len(a)), _powers(_INVERSE, len(a)))
        inside = ~_SPACE[a]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        own = offsets[np.searchsorted(offsets, start, "right"):np.searchsorted(offsets, end, "left")] - start
        first[own] = inside[own]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_TABLE[a] * power[:len(a)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64)))
        places.append(begins + start)
        start = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets, "left")


def row_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(stop, n)
        row = min(stop, n)
