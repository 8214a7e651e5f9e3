"""Sinks: chart-ready result tables, metric tables and previews.

Results are written by Spark itself, in parallel, partitioned by cluster
so a reader of one cluster's chart prunes the others. Nothing is
collected to the driver to be written from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_result(df: DataFrame, path: str, partition_by: Sequence[str] = ("cluster",),
                 fmt: str = "parquet", mode: str = "overwrite", compact: bool = False) -> str:
    """Write a report as a table (re-aimed chart output, S7).

    Partition columns that the frame does not have are skipped.
    ``mode="overwrite_partitions"`` replaces only the partitions (clusters)
    that the frame has rows of, so a rerun for one cluster gives the same
    table and leaves the others. New files are staged and take the old
    ones' place when the job commits: a failed job leaves the old table.
    Every task writes its own files, with no shuffle, so a cluster holding
    most rows does not funnel them through one task. ``compact=True`` is
    for a report known to be small (bins x groups): one task, one file per
    partition value.
    """
    parts = [c for c in partition_by if c in df.columns]
    out = df.coalesce(1) if compact else df
    if mode == "overwrite_partitions":
        if not parts:
            raise ValueError(f"none of {list(partition_by)} is a column: there is no partition to replace")
        writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
    else:
        writer = out.write.mode(mode).format(fmt)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.save(path)
    return path


def chart_table(df: DataFrame, bin_col: str, label_col: str, value_col: str,
                by: Sequence[str] = ()) -> DataFrame:
    """Normalise a binned report to ``*by, bin, label, value`` for plotting."""
    return df.select(*by, F.col(bin_col).alias("bin"), F.col(label_col).alias("label"),
                     F.col(value_col).cast("double").alias("value"))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 20) -> DataFrame:
    """First ``n`` rows in an explicit order (S4, O2); a limit is the feature here."""
    return df.orderBy(*order_by).limit(n)
