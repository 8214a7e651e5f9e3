"""Wide CSV exports whose files differ in their headers (S3).

A utilisation export has one file per day or shift, and units come and go:
a file may list its columns in another order or lack some. Each file's
header is read on its own, and every cell is placed by its header, never
by its position in another file. The width comes from the data: the union
of all headers, numbered in the order in which the sorted files first
name them.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.states import lit_sql, q
from .schemas import all_strings

#: Headers that are fetched at a time.
_AT_ONCE = 16


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """The data files at ``path`` (a file, folder or pattern), sorted; only names are read."""
    listed = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    return sorted(r.path for r in listed.collect())


def read_headers(spark: SparkSession, files: list[str], sep: str = ",") -> dict[str, tuple[str, ...]]:
    """The header of each file: one line a file reaches the driver."""
    def header(file: str) -> tuple[str, ...]:
        line = spark.read.text(file).take(1)[0].value
        return tuple(next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep)))

    with ThreadPoolExecutor(_AT_ONCE) as pool:
        return dict(zip(files, pool.map(header, files)))


def reconcile(headers: dict[str, tuple[str, ...]], time_col: str = "Time") -> list[str]:
    """All unit headers, in the order in which the sorted files first name them."""
    units: dict[str, None] = {}
    for file in sorted(headers):
        names = headers[file]
        if time_col not in names:
            raise ValueError(f"no {time_col!r} column in {file}")
        if len(set(names)) < len(names):
            raise ValueError(f"a column is named twice in {file}")
        units.update(dict.fromkeys(n for n in names if n != time_col))
    return list(units)


def read_wide_long(spark: SparkSession, path: str, time_col: str = "Time", sep: str = ",") -> tuple[DataFrame, dict[str, str]]:
    """``(time, unit, util, position)`` rows of all files at ``path``, and ``{col_i: header}``.

    Files with one header are one scan, whose schema is that header. Each
    scan turns its rows into long form at once (one ``posexplode``), so
    files that lack a column have no rows for it, and the union has four
    columns however wide the export is. ``unit`` is the original header,
    ``position`` its number in the union. Cells that are no numbers are NULL.
    """
    files = csv_files(spark, path)
    headers = read_headers(spark, files, sep)
    units = reconcile(headers, time_col)
    place = {u: i + 1 for i, u in enumerate(units)}
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        groups.setdefault(headers[file], []).append(file)
    out = spark.createDataFrame([], "time string, unit string, util double, position int")
    for names, members in groups.items():
        raw = spark.read.option("header", "true").option("enforceSchema", "true").option("sep", sep) \
            .schema(all_strings([f"c{i}" for i in range(len(names))])).csv(members)
        at = [i for i, n in enumerate(names) if n != time_col]
        if not at:
            continue
        cells = ", ".join(f"try_cast(c{i} AS double)" for i in at)
        labels, places = ", ".join(lit_sql(names[i]) for i in at), ", ".join(str(place[names[i]]) for i in at)
        long = raw.selectExpr(f"c{names.index(time_col)} AS time", f"posexplode(array({cells})) AS (_pos, util)")
        out = out.unionByName(long.selectExpr("time", f"element_at(array({labels}), _pos + 1) AS unit", "util",
                                              f"element_at(array({places}), _pos + 1) AS position"))
    return out, {f"col_{i}": u for u, i in place.items()}


def read_wide_reconciled(spark: SparkSession, path: str, time_col: str = "Time", sep: str = ",") -> tuple[DataFrame, dict[str, str]]:
    """The same files as one wide table ``time, col_1 .. col_n`` (text cells; NULL where a file lacks the column)."""
    files = csv_files(spark, path)
    headers = read_headers(spark, files, sep)
    units = reconcile(headers, time_col)
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        groups.setdefault(headers[file], []).append(file)
    out = spark.createDataFrame([], all_strings(["time", *[f"col_{i + 1}" for i in range(len(units))]]))
    for names, members in groups.items():
        raw = spark.read.option("header", "true").option("enforceSchema", "true").option("sep", sep) \
            .schema(all_strings([f"c{i}" for i in range(len(names))])).csv(members)
        at = {n: f"c{i}" for i, n in enumerate(names)}
        out = out.union(raw.selectExpr(f"{at[time_col]} AS time", *[
            f"{at.get(u, 'CAST(NULL AS string)')} AS col_{i + 1}" for i, u in enumerate(units)]))
    return out, {f"col_{i + 1}": u for i, u in enumerate(units)}


def write_wide(df: DataFrame, path: str, time_col: str = "time") -> str:
    """A wide table as header CSV (``Time`` first), as the utilisation exports are; files are written in parallel."""
    names = [c for c in df.columns if c != time_col]
    df.select(F.col(time_col).alias("Time"), *[F.expr(q(c)) for c in names]).write.mode("append").option("header", "true").csv(path)
    return path
