"""The original study's reports, one function each, over CSV exports.

Each function takes a session and file paths (any Hadoop-readable URI),
reads the exports as text, normalises them, and returns the report as a
DataFrame; ``write_result`` stores one as a table partitioned by cluster.
Clusters are read in one union, so a two-cluster report is one scan and
one aggregation rather than one job per cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import BinSpec
from ..operators.latency import GPU_BINS_150, QUEUE_BINS, cancels_by_queue_bin, mean_by_bin
from ..operators.ml import STUDY_MODELS, FeatureSpec, ModelSpec, evaluate, hash_split
from ..operators.normalize import normalize_jobs, training_rows, with_intervals
from ..operators.occupancy import gpu_occupancy, gpus_in_use_at
from ..operators.shares import state_shares, unsuccessful_breakdown
from ..operators.utilization import histogram, unit_means, util_bands
from ..sources.readers import read_clusters, read_csv
from ..sources.sinks import preview
from ..sources.wide import read_wide_long


def preview_export(spark: SparkSession, path: str, n: int = 20,
                   order_by: Sequence[str] | None = None) -> DataFrame:
    """Connectivity check: the first ``n`` rows of a CSV export, as text.
    With ``order_by`` the rows are the first in that order; without it,
    any ``n`` rows (Spark stops reading once it has them)."""
    df = read_csv(spark, path)
    return preview(df, order_by, n) if order_by else df.limit(n)


def load_tasks(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Task exports, one CSV per cluster, as one normalised job log."""
    raw = read_clusters(spark, paths, reader=lambda s, p: read_csv(s, p))
    return normalize_jobs(raw)


def task_state_shares(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Share of jobs per end state, per cluster."""
    return state_shares(load_tasks(spark, paths), by=["cluster"])


def task_gpu_time_shares(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Share of GPU time per end state, per cluster."""
    return state_shares(load_tasks(spark, paths), by=["cluster"], weight="gpu_time")


def task_type_state_shares(spark: SparkSession, paths: Mapping[str, str],
                           task_types: Sequence[str] = ("Eval", "Pretrain")) -> DataFrame:
    """Share of jobs per end state, per cluster and job type."""
    jobs = load_tasks(spark, paths)
    jobs = jobs.where(jobs.task_type.isin(list(task_types)))
    return state_shares(jobs, by=["cluster", "task_type"])


def unsuccessful_jobs(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Cancelled jobs as a share of unsuccessful ones, by count and GPU time."""
    return unsuccessful_breakdown(load_tasks(spark, paths), by=["cluster"])


def queue_by_gpus_in_use(spark: SparkSession, paths: Mapping[str, str],
                         specs: Mapping[str, BinSpec] | BinSpec = GPU_BINS_150,
                         task_types: Sequence[str] = ("Eval", "Pretrain")) -> DataFrame:
    """Mean queue delay per bin of GPUs already in use, per cluster and type.
    ``specs`` may map each cluster to its own layout (the study used
    ``GPU_BINS_150`` for the larger cluster and ``GPU_BINS_100`` for the
    smaller one); all layouts come out of one pass."""
    return mean_by_bin(load_tasks(spark, paths), "gpu_use_count", specs,
                       by=["cluster", "task_type"], task_types=task_types)


def cancels_by_queue_delay(spark: SparkSession, paths: Mapping[str, str],
                           spec: BinSpec = QUEUE_BINS,
                           task_types: Sequence[str] = ("Eval",)) -> DataFrame:
    """Cancelled jobs per queue-delay bin, per cluster."""
    return cancels_by_queue_bin(load_tasks(spark, paths), spec, task_types, by=["cluster"])


def unit_utilization(spark: SparkSession, paths: Mapping[str, str],
                     time_col: str = "Time", bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per-unit mean utilisation of wide GPU_UTIL exports: the histogram per
    cluster and the 10-point bands with zones."""
    frames = []
    for cluster, path in paths.items():
        rows, _ = read_wide_long(spark, path, time_col)
        frames.append(rows.withColumn("cluster", F.lit(cluster)))
    long = frames[0]
    for f in frames[1:]:
        long = long.unionByName(f)
    means = unit_means(long, by=["cluster"])
    return histogram(means, bins=bins, by=["cluster"]), util_bands(means, by=["cluster"])


def load_trace(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Raw job traces (job_id, user, type, state, node/gpu/cpu counts,
    submit_time, queue, duration[, start_time, end_time]) with intervals."""
    raw = read_clusters(spark, paths, reader=lambda s, p: read_csv(s, p))
    return with_intervals(normalize_jobs(raw))


def gpus_in_use(spark: SparkSession, paths: Mapping[str, str], at: str = "start") -> DataFrame:
    """The step the study describes but does not show: GPUs allocated by other
    jobs when each job starts (or is submitted), from the trace's intervals."""
    trace = load_trace(spark, paths)
    occ = gpu_occupancy(trace, probes="submit_us" if at == "submit" else None)
    return gpus_in_use_at(trace, occ, at=at, out="gpu_use_count")


def duration_models(spark: SparkSession, paths: Mapping[str, str],
                    spec: FeatureSpec = FeatureSpec(),
                    models: Sequence[ModelSpec] = STUDY_MODELS,
                    train_fraction: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Fit the duration models on completed jobs; metrics and importances."""
    rows = training_rows(load_trace(spark, paths), label=spec.label,
                         required=tuple(dict.fromkeys(spec.numeric + (spec.label,))))
    split = hash_split(rows, "job_id", train_fraction, seed)
    return evaluate(models, split.where("split = 'train'"), split.where("split = 'test'"), spec)
