"""Queue delay against a binned axis.

Binning is one projected integer column; grouping is on that integer (and
the caller's keys), so the shuffle carries a small fixed-width key and the
label text is attached after the aggregate. Several job types share one
scan and one aggregation (A13) instead of one job per type.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import (BinSpec, bin_index_by_sql, bin_index_sql, bin_label_by_sql,
                                bin_label_sql)
from ..functions.numeric import mean_sql
from ..functions.states import lit_sql, q

# Bin layouts used in the original study.
GPU_BINS_150 = BinSpec(0, 1950, 150)      # larger cluster, 150-wide
GPU_BINS_100 = BinSpec(0, 1300, 100)      # smaller cluster, 100-wide
QUEUE_BINS = BinSpec(0, 300, 20, overflow_label=">300")


def _prepare(jobs: DataFrame, task_types: Sequence[str] | None, where) -> DataFrame:
    if task_types is not None:  # an empty list selects nothing
        jobs = jobs.where(F.expr(f"task_type IN ({', '.join(lit_sql(t) for t in task_types)})")
                          if task_types else F.lit(False))
    if where is not None:
        jobs = jobs.where(where)
    return jobs


Specs = BinSpec | Mapping[str, BinSpec]


def _bin_sql(x: str, spec: Specs, key: str) -> str:
    if isinstance(spec, BinSpec):
        return bin_index_sql(q(x), spec)
    return bin_index_by_sql(q(x), spec, q(key))


def _finish(agg: DataFrame, spec: Specs, by: list[str], bin_col: str,
            label_col: str, sort: bool, key: str = "cluster",
            unknown_bin: int | None = None) -> DataFrame:
    label = (bin_label_sql(q(bin_col), spec) if isinstance(spec, BinSpec)
             else bin_label_by_sql(q(bin_col), spec, q(key)))
    out = agg.withColumns({label_col: F.expr(label)})
    if unknown_bin is not None:
        # a non-NULL index for Unknown keeps the column a plain integer
        # wherever the result goes (pandas would turn NULL ints into floats)
        out = out.withColumn(bin_col, F.coalesce(F.col(bin_col), F.lit(int(unknown_bin))))
    if sort:
        out = out.orderBy(*by, F.col(bin_col).asc_nulls_last())
    return out


def mean_by_bin(jobs: DataFrame, x: str, spec: Specs, value: str = "queue",
                by: Sequence[str] = (), task_types: Sequence[str] | None = None,
                where=None, scale: int | None = None, bin_col: str = "bin",
                label_col: str = "label", sort: bool = True,
                spec_key: str = "cluster", unknown_bin: int | None = None) -> DataFrame:
    """Mean of ``value`` per bin of ``x`` (and per ``by``).

    ``spec`` is one ``BinSpec`` or a mapping ``{key value: BinSpec}`` giving
    each value of ``spec_key`` (a cluster, usually) its own bin layout; then
    ``spec_key`` must be in ``by``, and all layouts still come out of one
    scan and one aggregation.
    ``scale`` makes the mean exact at that many decimals (decimal sum /
    count), so it does not depend on partitioning; ``None`` sums doubles.
    The Unknown bin has a NULL index unless ``unknown_bin`` gives one.
    Output: ``*by, bin, n_jobs, mean_<value>, label``.
    """
    by = list(by)
    if not isinstance(spec, BinSpec) and spec_key not in by:
        raise ValueError(f"per-{spec_key} bin specs need {spec_key!r} in by")
    df = _prepare(jobs, task_types, where)
    mean = mean_sql(q(value), scale)
    agg = df.groupBy(*by, F.expr(_bin_sql(x, spec, spec_key)).alias(bin_col)).agg(
        F.expr("count(1) AS n_jobs"), F.expr(f"{mean} AS {q('mean_' + value)}"))
    return _finish(agg, spec, by, bin_col, label_col, sort, spec_key, unknown_bin)


def count_by_bin(jobs: DataFrame, x: str, spec: Specs, by: Sequence[str] = (),
                 task_types: Sequence[str] | None = None, where=None,
                 bin_col: str = "bin", label_col: str = "label",
                 sort: bool = True, spec_key: str = "cluster",
                 unknown_bin: int | None = None) -> DataFrame:
    """Number of jobs per bin of ``x``. Output: ``*by, bin, n_jobs, label``.
    ``spec`` may be per ``spec_key`` value, as in ``mean_by_bin``."""
    by = list(by)
    if not isinstance(spec, BinSpec) and spec_key not in by:
        raise ValueError(f"per-{spec_key} bin specs need {spec_key!r} in by")
    df = _prepare(jobs, task_types, where)
    agg = df.groupBy(*by, F.expr(_bin_sql(x, spec, spec_key)).alias(bin_col)).agg(
        F.expr("count(1) AS n_jobs"))
    return _finish(agg, spec, by, bin_col, label_col, sort, spec_key, unknown_bin)


def cancels_by_queue_bin(jobs: DataFrame, spec: BinSpec = QUEUE_BINS,
                         task_types: Sequence[str] | None = ("Eval",),
                         by: Sequence[str] = (), label_col: str = "state_label") -> DataFrame:
    """Cancelled jobs per queue-delay bin (the filter reaches the scan)."""
    return count_by_bin(jobs, "queue", spec, by=by, task_types=task_types,
                        where=F.expr(f"{q(label_col)} = 'Canceled'"))
