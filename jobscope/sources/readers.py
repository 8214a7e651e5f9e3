"""Sources: CSV / Parquet scans, the per-cluster registry and wide tables.

S1  ``read_csv``       header CSV, every column as text (types come later,
                        through try_cast in ``operators.normalize``)
S2  ``read_clusters``  one path per cluster, tagged and unioned by name
    ``read_registry``  the same in one scan, cluster taken from the file's path
S1  ``quarantine``     rows that don't parse go to a table of bad records
S3  ``read_wide``      wide utilisation table: first column is time, the
                        rest are units; columns renamed positionally and
                        the original header kept for the long form (files
                        with different headers: ``sources.wide``)
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.states import lit_sql, q
from .schemas import all_strings


def read_csv(spark: SparkSession, path: str, columns=None, *,
             mode: str = "PERMISSIVE", sep: str = ",",
             corrupt_col: str | None = None) -> DataFrame:
    """Header CSV as text columns.

    With ``columns`` the schema is given up front (no inference pass, no
    header-sniffing job); without it, Spark reads the header only and
    every column is a string, as it would be without ``inferSchema``.
    ``corrupt_col`` (with ``columns`` and PERMISSIVE mode) keeps the raw text
    of rows that do not parse, e.g. with too many fields.
    """
    reader = spark.read.option("header", "true").option("mode", mode).option("sep", sep)
    if columns is not None:
        names = list(columns) + ([corrupt_col] if corrupt_col else [])
        # names are held against the header, not bound by position
        reader = reader.schema(all_strings(names)).option("enforceSchema", "false")
        if corrupt_col:
            # all columns are parsed, whichever a query needs: only so a wrong number of fields shows
            reader = reader.option("columnNameOfCorruptRecord", corrupt_col).option("columnPruning", "false")
    return reader.csv(path)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **csv_opts) -> DataFrame:
    """Parquet (columnar, pushdown) or CSV by extension or ``fmt``."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if fmt == "csv":
        return read_csv(spark, path, **csv_opts)
    return spark.read.format(fmt).load(path)


def read_clusters(spark: SparkSession, paths: Mapping[str, str],
                  reader: Callable[[SparkSession, str], DataFrame] | None = None,
                  cluster_col: str = "cluster") -> DataFrame:
    """Read one table per cluster and union them with a ``cluster`` tag.

    One scan per path, no shuffle; a query over the union groups by
    cluster in a single pass instead of one job per cluster.
    """
    reader = reader or read_table
    frames = [reader(spark, p).withColumn(cluster_col, F.lit(name))
              for name, p in paths.items()]
    if not frames:
        raise ValueError("no cluster paths given")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


_NO_SCHEME = "regexp_replace({}, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?', '')"


def read_registry(spark: SparkSession, paths: Mapping[str, str], columns=None,
                  cluster_col: str = "cluster", **csv_opts) -> DataFrame:
    """All clusters' CSV exports in one scan (S2); the cluster comes from each file's path.

    ``paths`` maps a cluster to its file or folder (no pattern); of nested
    folders the longest one decides. Without ``columns`` the exports must
    have one header. The tag is an expression over ``_metadata.file_path``,
    which is known before a file is opened: a filter on the cluster leaves
    the other clusters' files unread.
    """
    if not paths:
        raise ValueError("no cluster paths given")
    if bad := [p for p in paths.values() if any(c in p for c in "*?[{")]:
        raise ValueError(f"a pattern names no single folder: {bad[0]}")
    raw = read_csv(spark, list(paths.values()), columns, **csv_opts)
    file = _NO_SCHEME.format("url_decode(replace(_metadata.file_path, '+', '%2B'))")
    arms = []
    for name, path in sorted(paths.items(), key=lambda x: -len(x[1])):
        plain = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")
        arms.append(f"WHEN {file} = {lit_sql(plain)} OR startswith({file}, {lit_sql(plain + '/')}) THEN {lit_sql(name)}")
    return raw.withColumn(cluster_col, F.expr(f"CASE {' '.join(arms)} END"))


def quarantine(spark: SparkSession, path: str, columns, out: str, *, numeric=(), header: bool = True,
               sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """Parse a CSV export once and store what parses apart from what doesn't.

    Returns ``(good, bad)``: the good rows' text columns, and
    ``(file, reason, raw)`` of the others. A row is bad if it has too many
    or too few fields (``fields``), or if one of its ``numeric`` cells is
    text that is no number (``number: <column>``, the first such column).
    A quote inside quotes is doubled. ``raw`` is the line as it stands, or
    the row's cells where only a number is wrong.
    Both are read from ``out``, where one job wrote them side by side, so
    the counts belong to the same parse and no row is in neither.
    """
    names = list(columns)
    reader = spark.read.option("mode", "PERMISSIVE").option("sep", sep).option("header", str(header).lower()) \
        .option("enforceSchema", "false").option("columnNameOfCorruptRecord", "_raw").option("columnPruning", "false") \
        .option("escape", '"')
    rows = reader.schema(all_strings([*names, "_raw"])).csv(path)
    arms = ["WHEN _raw IS NOT NULL THEN 'fields'"] + [
        f"WHEN {q(c)} IS NOT NULL AND try_cast({q(c)} AS double) IS NULL THEN {lit_sql('number: ' + c)}" for c in numeric]
    line = f"coalesce(_raw, concat_ws({lit_sql(sep)}, {', '.join(f'coalesce({q(c)}, {lit_sql(str())})' for c in names)}))"
    marked = rows.selectExpr(*map(q, names), "_metadata.file_path AS file", f"CASE {' '.join(arms)} END AS reason", f"{line} AS raw")
    cells = [f"CASE WHEN reason IS NULL THEN {q(c)} END AS {q(c)}" for c in names]
    kept = marked.selectExpr(*cells, "file", "reason", "CASE WHEN reason IS NOT NULL THEN raw END AS raw", "reason IS NOT NULL AS bad")
    kept.write.partitionBy("bad").parquet(out)
    stored = spark.read.schema(kept.schema).parquet(out)
    return stored.where("NOT bad").select(*names), stored.where("bad").select("file", "reason", "raw")


def bad_record_counts(bad: DataFrame) -> DataFrame:
    """Bad rows per file and reason."""
    return bad.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))


def rename_wide(df: DataFrame, time_col: str = "Time") -> tuple[DataFrame, dict[str, str]]:
    """Keep the time column, rename the others ``col_1 .. col_n``.

    Returns the renamed frame and ``{col_i: original header}`` so that the
    long form can carry the real unit name.
    """
    cols = df.columns
    if time_col not in cols:
        raise ValueError(f"no {time_col!r} column in {cols[:5]}...")
    renamed, names, i = [], {}, 0
    for c in cols:
        if c == time_col:
            renamed.append("time")
        else:
            i += 1
            renamed.append(f"col_{i}")
            names[f"col_{i}"] = c
    # one positional rename (a single JVM call however wide the table is)
    return df.toDF(*renamed), names


def read_wide(spark: SparkSession, path: str, time_col: str = "Time",
              fmt: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Wide utilisation table (S3): ``time, col_1 .. col_n`` plus header map."""
    return rename_wide(read_table(spark, path, fmt), time_col)
