"""Canonical schemas and the header alias map.

Job logs arrive with different headers (``TaskStatus`` in one export,
``Status`` or ``state`` in another). Every alias is mapped onto one
canonical name at ingest; extend ``JOB_ALIASES`` for new exports.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Header aliases seen in job logs -> canonical column.
JOB_ALIASES = {
    "TaskType": "task_type",
    "type": "task_type",
    "TaskStatus": "state",
    "Status": "state",
    "GPU_Time": "gpu_time",
    "GpuUseCount": "gpu_use_count",
    "Queue": "queue",
    "Duration": "duration",
    "JobId": "job_id",
    "User": "user",
}

# Canonical job-log columns and their types. Every numeric column is
# read as text and converted with try_cast, so a malformed cell becomes
# NULL instead of failing the job.
JOB_COLUMNS = {
    "cluster": T.StringType(),
    "job_id": T.StringType(),
    "user": T.StringType(),
    "task_type": T.StringType(),
    "state": T.StringType(),
    "gpu_time": T.DoubleType(),
    "gpu_use_count": T.LongType(),
    "queue": T.DoubleType(),
    "duration": T.DoubleType(),
    "node_num": T.DoubleType(),
    "gpu_num": T.DoubleType(),
    "cpu_num": T.DoubleType(),
    "submit_time": T.TimestampType(),
    "start_time": T.TimestampType(),
    "end_time": T.TimestampType(),
}


def all_strings(names) -> T.StructType:
    """A CSV read schema that keeps every listed column as text."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
