"""Session helpers: a local session for tests/bench, and the shared folder
that lineage cuts and round-trip writes go to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every jobscope session should carry. AQE sizes shuffles at run
# time; the timezone makes timestamp -> epoch conversions reproducible.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Starting points for a large cluster (1000+ executors, ~100 TB inputs):
# many initial shuffle partitions that AQE coalesces to ~256 MB each, input
# splits of 256 MB, skew splitting for hot join keys, and a broadcast limit
# that AQE checks against runtime sizes.
CLUSTER_CONF = {
    **{k: v for k, v in DEFAULT_CONF.items() if not k.startswith("spark.ui.")},
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.pivotMaxValues": "10000",
}


def apply_conf(spark: SparkSession, conf: dict) -> None:
    """Set runtime SQL settings on an existing session (static ones are skipped)."""
    for k, v in conf.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "jobscope", extra: dict | None = None) -> SparkSession:
    """A local session configured the way tests and the bench expect."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("JOBSCOPE_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    The session's setting wins. Only a local session without one gets a
    fresh temporary folder (tests, laptop runs); on a cluster a missing
    setting is an error, because a machine-local folder is not visible to
    other executors and does not survive their loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder every "
            "executor can reach (HDFS, S3, ...) before running jobscope")
    folder = tempfile.mkdtemp(prefix="jobscope-shared-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
