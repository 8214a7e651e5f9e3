"""The end-state report over a job log that keeps arriving.

A scheduler exports finished jobs as files into a folder; Structured
Streaming picks each new file up once, and the same operators as the
batch reports keep running totals per cluster and end state in the
state store (checkpointed to the shared folder, so a restarted query
resumes where it stopped). Shares are arithmetic on those totals, so each
micro-batch shuffles only its own partial counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.numeric import pct
from ..operators.normalize import normalize_jobs
from ..session import scratch_path


def job_log_stream(spark: SparkSession, path: str, schema: T.StructType,
                   fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming job log read from files dropped into ``path``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return normalize_jobs(reader.load(path))


def running_state_counts(jobs: DataFrame, by: Sequence[str] = ("cluster",),
                         label_col: str = "state_label") -> DataFrame:
    """Running count of jobs per group and end-state label (stateful aggregate)."""
    return jobs.groupBy(*by, label_col).agg(F.count(F.lit(1)).alias("n_jobs"))


def shares_of(counts: DataFrame, by: Sequence[str] = ("cluster",),
              label_col: str = "state_label") -> DataFrame:
    """Turn a snapshot of running counts into shares (a small batch step).

    The snapshot holds one row per group and label, so a window per group
    over it is cheap.
    """
    total = F.sum("n_jobs").over(Window.partitionBy(*by))
    return counts.withColumn("pct_of_all", pct(F.col("n_jobs"), total))


def start_running_counts(jobs: DataFrame, query_name: str, by: Sequence[str] = ("cluster",),
                         checkpoint: str | None = None, sink: str = "memory",
                         trigger_seconds: int | None = None,
                         snapshot_path: str | None = None) -> StreamingQuery:
    """Start the running-count query; ``complete`` mode re-emits all totals.

    ``sink="snapshot"`` writes every micro-batch's totals (one row per group
    and label) over ``snapshot_path`` as Parquet with ``foreachBatch``, the
    way to keep a current table on shared storage; other values are passed
    to ``format`` (``memory`` for tests and notebooks).
    """
    spark = jobs.sparkSession
    writer = (running_state_counts(jobs, by).writeStream.outputMode("complete")
              .queryName(query_name)
              .option("checkpointLocation", checkpoint or scratch_path(spark, f"ckpt-{query_name}")))
    if sink == "snapshot":
        if not snapshot_path:
            raise ValueError("sink='snapshot' needs snapshot_path")
        writer = writer.foreachBatch(
            lambda batch, _epoch: batch.write.mode("overwrite").parquet(snapshot_path))
    else:
        writer = writer.format(sink)
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()
