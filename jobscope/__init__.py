"""jobscope — workload analytics for GPU training clusters on Spark.

Every operator takes a DataFrame and returns a DataFrame. Nothing is
collected inside an operator except bounded metadata (bin edges, quantile
split points, model parameters); the caller decides when to act on a
result. The main operators are importable from here; the duration models
live in ``jobscope.operators.ml`` and the study's reports in
``jobscope.plans.study``.
"""

from .functions.binning import BinSpec
from .operators.latency import (GPU_BINS_100, GPU_BINS_150, QUEUE_BINS, cancels_by_queue_bin,
                                count_by_bin, mean_by_bin)
from .operators.normalize import normalize_jobs, training_rows, with_intervals
from .operators.occupancy import gpu_occupancy, gpus_in_use_at, running_sum
from .operators.shares import state_shares, unsuccessful_breakdown
from .operators.utilization import histogram, unit_means, util_bands, wide_to_long
from .sources.readers import read_clusters, read_csv, read_table, read_wide
from .sources.sinks import chart_table, preview, write_result

__version__ = "0.1.0"

__all__ = [
    "BinSpec", "GPU_BINS_100", "GPU_BINS_150", "QUEUE_BINS",
    "cancels_by_queue_bin", "count_by_bin", "mean_by_bin",
    "normalize_jobs", "training_rows", "with_intervals",
    "gpu_occupancy", "gpus_in_use_at", "running_sum",
    "state_shares", "unsuccessful_breakdown",
    "histogram", "unit_means", "util_bands", "wide_to_long",
    "read_clusters", "read_csv", "read_table", "read_wide",
    "chart_table", "preview", "write_result",
]
