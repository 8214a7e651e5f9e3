"""Named report queries over the test tables, each with a DuckDB oracle.

Every query reads whole tables through the adapters in
``sources.adapters`` and runs one of the library's operators. The oracle
SQL recomputes the same report independently from the raw tables; column
names and types match the Spark result. Shares and means of money-like
values come from exact decimal sums and one division on both sides, so
they agree bit for bit; where a double depends on summation order (means
of float samples, model metrics, fitted coefficients) both sides round to
6 decimals.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import BinSpec
from ..operators.explain import feature_slots, pca_loadings, permutation_importance
from ..operators.group_stats import OWN_COL, GroupStatistics
from ..operators.latency import QUEUE_BINS, count_by_bin, mean_by_bin
from ..operators.ml import (STUDY_MODELS, FeatureSpec, ModelSpec, evaluate, fit_features, group_mean_baseline,
                            hash_sample, hash_split, linear_fit, minmax_scaled, string_indexes, HASH_SPACE)
from ..operators.normalize import normalize_jobs, training_rows, with_intervals
from ..operators.occupancy import gpu_occupancy, gpus_in_use_at, mean_by_occupancy, occupancy_step
from ..operators.ranking import exact_sample
from ..operators.utilization import histogram, unit_means, util_bands, wide_to_long
from ..operators.shares import state_shares, unsuccessful_breakdown
from ..session import scratch_path
from ..sources.adapters import (jobs_from_events, jobs_from_orders, load,
                                util_from_lineitem, wide_daily_from_events,
                                wide_from_embeddings)
from ..sources.readers import bad_record_counts, quarantine, read_clusters, read_csv, read_registry
from ..sources.sinks import preview, write_result
from ..sources.wide import read_wide_long, write_wide

Query = Callable[[SparkSession, str], DataFrame]

# Bin layouts for the test tables (GPUs in use on events run 0..99).
GPU_BINS_TEST = BinSpec(0, 80, 10)
OCCUPANCY_BINS_TEST = BinSpec(0, 80, 10)
# one layout per cluster, as the study used 150-wide and 100-wide bins
GPU_BINS_PER_CLUSTER = {"A": BinSpec(0, 80, 10), "B": BinSpec(0, 100, 25)}
QUANTITY_BINS = BinSpec(0, 50, 10)
# reports give the Unknown bin index -1 so the bin column never holds NULL
UNKNOWN_BIN = -1


# ---------------------------------------------------------------- inputs

def jobs_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_jobs(jobs_from_orders(load(spark, sf_dir, "orders")))


def jobs_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_jobs(jobs_from_events(load(spark, sf_dir, "events")))


# --------------------------------------------------------------- queries

def q01_csv_ingest(spark, sf_dir):
    """Round trip through header CSV (all text), then typed per-state totals."""
    path = scratch_path(spark, "q01-jobs-csv")
    jobs_from_orders(load(spark, sf_dir, "orders")).write.mode("overwrite") \
        .option("header", "true").csv(path)
    raw = read_csv(spark, path, columns=["job_id", "user", "cluster", "task_type",
                                         "state", "gpu_time"])
    jobs = normalize_jobs(raw)
    return jobs.groupBy(F.col("state_label").alias("state")).agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.sum(F.col("gpu_time").cast("decimal(18,2)")).cast("double").alias("gpu_time"))


def q02_state_share(spark, sf_dir):
    """Share of jobs per end state (all labels, zero when absent)."""
    return state_shares(jobs_o(spark, sf_dir))


def q03_state_share_by_cluster(spark, sf_dir):
    """Share of jobs per end state and cluster — the flagship report."""
    return state_shares(jobs_o(spark, sf_dir), by=["cluster"])


def q03b_state_share_from_cluster_exports(spark, sf_dir):
    """Per-cluster CSV exports (as a scheduler writes them) read back through
    the cluster registry: the tag comes from the registry, not the file."""
    path = scratch_path(spark, "q03b-exports")
    jobs_from_orders(load(spark, sf_dir, "orders")).write.mode("overwrite") \
        .partitionBy("cluster").option("header", "true").csv(path)
    exports = {c: f"{path}/cluster={c}" for c in ("A", "B")}
    raw = read_clusters(spark, exports, reader=lambda s, p: read_csv(s, p))
    return state_shares(normalize_jobs(raw), by=["cluster"])


def q04_gpu_time_by_state(spark, sf_dir):
    """Exact GPU time per end state."""
    return state_shares(jobs_o(spark, sf_dir), weight="gpu_time", scale=SCALE) \
        .select("state", "state_order", "gpu_time")


def q05_gpu_time_share_by_cluster(spark, sf_dir):
    """GPU-time shares per end state and cluster."""
    return state_shares(jobs_o(spark, sf_dir), by=["cluster"], weight="gpu_time", scale=SCALE)


def q06_state_share_by_type(spark, sf_dir):
    """Shares per job type (Eval, Pretrain)."""
    jobs = jobs_o(spark, sf_dir).where(F.col("task_type").isin("Eval", "Pretrain"))
    return state_shares(jobs, by=["task_type"])


def q07_known_state_share(spark, sf_dir):
    """Shares with two unknown raw states, per cluster and job type."""
    return state_shares(jobs_e(spark, sf_dir), by=["cluster", "task_type"])


def q08_queue_by_gpu_bin(spark, sf_dir):
    """Eval mean queue delay per bin of GPUs already in use."""
    return mean_by_bin(jobs_e(spark, sf_dir), "gpu_use_count", GPU_BINS_TEST,
                       task_types=["Eval"], unknown_bin=UNKNOWN_BIN, scale=SCALE)


def q08c_discount_by_quantity_bin(spark, sf_dir):
    """Exact mean of a value with four decimals per bin of another column."""
    items = load(spark, sf_dir, "lineitem").selectExpr("l_quantity", "l_extendedprice * l_discount AS discount")
    return mean_by_bin(items, "l_quantity", QUANTITY_BINS, value="discount", unknown_bin=UNKNOWN_BIN, scale=4)


def q08b_queue_by_gpu_bin_per_cluster(spark, sf_dir):
    """Same, each cluster with its own bin layout, in one pass."""
    return mean_by_bin(jobs_e(spark, sf_dir), "gpu_use_count", GPU_BINS_PER_CLUSTER,
                       by=["cluster"], task_types=["Eval"], unknown_bin=UNKNOWN_BIN, scale=SCALE)


def q09_queue_by_gpu_bin_and_type(spark, sf_dir):
    """Eval and Pretrain on one GPU axis, in one pass."""
    return mean_by_bin(jobs_e(spark, sf_dir), "gpu_use_count", GPU_BINS_TEST,
                       by=["task_type"], task_types=["Eval", "Pretrain"],
                       unknown_bin=UNKNOWN_BIN, scale=SCALE)


def q10_queue_bins_all_states(spark, sf_dir):
    """Jobs per queue-delay bin, with the >300 overflow bin."""
    return count_by_bin(jobs_e(spark, sf_dir), "queue", QUEUE_BINS, unknown_bin=UNKNOWN_BIN)


def q11_cancels_by_queue_bin(spark, sf_dir):
    """Cancelled Eval jobs per queue-delay bin."""
    return count_by_bin(jobs_e(spark, sf_dir), "queue", QUEUE_BINS, task_types=["Eval"],
                        where="state_label = 'Canceled'", unknown_bin=UNKNOWN_BIN)


def q12_unsuccessful_breakdown(spark, sf_dir):
    """Cancelled share of unsuccessful jobs, by count and GPU time."""
    return unsuccessful_breakdown(jobs_o(spark, sf_dir), by=["cluster"], scale=SCALE)


def q13_unit_mean_util(spark, sf_dir):
    """Per-unit mean of a wide utilisation table, as wide as its longest row."""
    wide = wide_from_embeddings(load(spark, sf_dir, "embeddings"))
    return unit_means(wide_to_long(wide), digits=6)


def q13b_unit_mean_util_daily(spark, sf_dir):
    """Per-unit mean of a daily pivot (one column per event type)."""
    wide = wide_daily_from_events(load(spark, sf_dir, "events"))
    return unit_means(wide_to_long(wide), digits=6)


def _line_unit_means(spark, sf_dir):
    return unit_means(util_from_lineitem(load(spark, sf_dir, "lineitem")), digits=6)


def q14_util_histogram(spark, sf_dir):
    """10-bin histogram of per-unit means, numpy's binning rule."""
    return histogram(_line_unit_means(spark, sf_dir), bins=10)


def q15_util_bands(spark, sf_dir):
    """Units per 10-point utilisation band, with zones."""
    return util_bands(_line_unit_means(spark, sf_dir))


def q16_gpu_occupancy(spark, sf_dir):
    """GPUs in use after every allocation change, per cluster."""
    return gpu_occupancy(jobs_e(spark, sf_dir)).select("cluster", "t", "gpus_in_use")


def q16b_occupancy_of_odd_jobs(spark, sf_dir):
    """GPUs in use where jobs still run, end as or before they start, or have no cluster."""
    jobs = jobs_e(spark, sf_dir).withColumns({
        "end_us": F.expr("CASE WHEN gpu_use_count % 11 = 0 THEN NULL WHEN gpu_use_count % 7 = 0 THEN start_us "
                         "WHEN gpu_use_count % 13 = 0 THEN start_us - 1000000 ELSE end_us END"),
        "cluster": F.expr("CASE WHEN gpu_use_count % 5 > 0 THEN cluster END")})
    return gpu_occupancy(jobs).select(F.coalesce("cluster", F.lit("none")).alias("cluster"), "t", "gpus_in_use")


def q17_queue_by_occupancy(spark, sf_dir):
    """Mean queue delay by GPUs used by others when a job starts."""
    jobs = jobs_e(spark, sf_dir)
    return mean_by_occupancy(jobs, gpu_occupancy(jobs), OCCUPANCY_BINS_TEST, by=["task_type"],
                             task_types=["Eval", "Pretrain"], unknown_bin=UNKNOWN_BIN, scale=SCALE)


def q17b_queue_by_occupancy_at_submit(spark, sf_dir):
    """Same, sampled when a job is submitted."""
    jobs = jobs_e(spark, sf_dir)
    return mean_by_occupancy(jobs, gpu_occupancy(jobs, probes="submit_us"),
                             OCCUPANCY_BINS_TEST, by=["task_type"], at="submit",
                             task_types=["Eval", "Pretrain"], unknown_bin=UNKNOWN_BIN, scale=SCALE)


# The test tables' duration is an exact function of the GPU columns, so
# the models here predict the queue delay instead and leave it out of the
# features.
TEST_FEATURES = FeatureSpec(label="queue", numeric=("node_num", "gpu_num", "cpu_num", "duration"))
#: The test values have two decimals: sums are exact with as many.
SCALE = 2
TRAIN_FRACTION = 0.8
SPLIT_SEED = 42
SAMPLE_SEED = 7


def _training(spark, sf_dir):
    rows = training_rows(jobs_e(spark, sf_dir), label=TEST_FEATURES.label,
                         required=TEST_FEATURES.numeric + (TEST_FEATURES.label,))
    return hash_split(rows, "job_id", TRAIN_FRACTION, SPLIT_SEED)


def _train_test(spark, sf_dir):
    rows = _training(spark, sf_dir)
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")


def q18_training_rows(spark, sf_dir):
    """Completed jobs, typed, rows with NULL features dropped, label set."""
    rows = training_rows(jobs_e(spark, sf_dir), label=TEST_FEATURES.label,
                         required=TEST_FEATURES.numeric + (TEST_FEATURES.label,))
    return rows.select("job_id", "user", "task_type", "node_num", "gpu_num", "cpu_num",
                       "duration", "queue", "label")


def q19_hash_split(spark, sf_dir):
    """Stable 80/20 split by a salted md5 of the job id."""
    return hash_split(jobs_e(spark, sf_dir), "job_id", TRAIN_FRACTION, SPLIT_SEED) \
        .select("job_id", "split")


def q20_minmax_features(spark, sf_dir):
    """MinMaxScaler fitted on the training rows."""
    train, _ = _train_test(spark, sf_dir)
    return minmax_scaled(train, TEST_FEATURES.numeric)


def q21_string_index(spark, sf_dir):
    """StringIndexer indexes (frequency, then text) on the training rows."""
    train, _ = _train_test(spark, sf_dir)
    return string_indexes(train, ["user", "task_type"])


def q22_baseline_metrics(spark, sf_dir):
    """Per-type mean predictor scored on the test rows."""
    train, test = _train_test(spark, sf_dir)
    return group_mean_baseline(train, test, group="task_type", scale=SCALE)


def q23_linear_one_feature(spark, sf_dir):
    """One-feature least squares with Spark ML's normal solver."""
    train, _ = _train_test(spark, sf_dir)
    return linear_fit(train, "gpu_use_count")


@functools.lru_cache(maxsize=4)
def _study_fit(app: str, sf_dir: str) -> tuple[str, str]:
    """Metrics and importances of one fit of the study's models, as stored tables, for this application."""
    spark = SparkSession.getActiveSession()
    train, test = _train_test(spark, sf_dir)
    paths = []
    for name, table in zip(("metrics", "importances"), evaluate(STUDY_MODELS, train, test, TEST_FEATURES)):
        paths.append(scratch_path(spark, f"study-{name}"))
        table.write.parquet(paths[-1])
    return tuple(paths)


def q24_model_metrics(spark, sf_dir):
    """LR, RF and GBT on shared features + PCA: metric rows."""
    return spark.read.parquet(_study_fit(spark.sparkContext.applicationId, sf_dir)[0])


def q25_feature_importance(spark, sf_dir):
    """RF and GBT feature importances over the PCA axes, of the models that q24 scores."""
    return spark.read.parquet(_study_fit(spark.sparkContext.applicationId, sf_dir)[1])


def q27_preview(spark, sf_dir):
    """First 20 jobs by GPU time, largest first (a limit is the feature)."""
    jobs = jobs_o(spark, sf_dir).select("job_id", "state", "gpu_time")
    return preview(jobs, [F.desc("gpu_time"), "job_id"], 20)


def q28_result_table(spark, sf_dir):
    """State shares per cluster written as a partitioned table and read back."""
    shares = state_shares(jobs_o(spark, sf_dir), by=["cluster"])
    return spark.read.parquet(write_result(shares, scratch_path(spark, "q28-shares"))).select(shares.columns)


def q29_hash_sample(spark, sf_dir):
    """A tenth of the jobs, chosen by a salted hash of their id (a sampling operator)."""
    return hash_sample(jobs_e(spark, sf_dir), "job_id", 0.1, SAMPLE_SEED).select("job_id")


# One split of a column with few values: what a tree does here is plain SQL.
STUMP_FEATURES = FeatureSpec(label="queue", numeric=("node_num",), categorical=(), grouped=(), pca_k=None)
STUMPS = (
    ModelSpec("rf", {"numTrees": 1, "maxDepth": 1, "bootstrap": False, "featureSubsetStrategy": "all", "seed": 42},
              name="one_tree"),
    ModelSpec("gbt", {"maxIter": 1, "maxDepth": 1, "seed": 42}, name="one_round"),
)


def q26_stump_metrics(spark, sf_dir):
    """Forest of one tree and boosting of one round, one split each: metric rows."""
    train, test = _train_test(spark, sf_dir)
    return evaluate(STUMPS, train, test, STUMP_FEATURES)[0]


# Two columns, two levels: each node takes the split with the greatest gain over all values of both.
TREE_FEATURES = FeatureSpec(label="queue", numeric=("node_num", "cpu_num"), categorical=(), grouped=(), pca_k=None)
TREES = (
    ModelSpec("rf", {"numTrees": 1, "maxDepth": 2, "bootstrap": False, "featureSubsetStrategy": "all", "seed": 42}, name="one_tree"),
    ModelSpec("gbt", {"maxIter": 1, "maxDepth": 2, "seed": 42}, name="one_round"),
)


def q40_two_level_tree_metrics(spark, sf_dir):
    """Forest of one tree and boosting of one round, two levels over two columns: metric rows."""
    train, test = _train_test(spark, sf_dir)
    return evaluate(TREES, train, test, TREE_FEATURES)[0]


def q13c_wide_exports_with_other_headers(spark, sf_dir):
    """Per-unit mean of wide CSV exports: one in order, one reversed, one that lacks columns."""
    wide = wide_from_embeddings(load(spark, sf_dir, "embeddings"))
    wide = wide.toDF("time", *[c.replace("col_", "gpu-") for c in wide.columns[1:]])
    units, path = wide.columns[1:], scratch_path(spark, "q13c-wide")
    for part, names in enumerate([units, units[::-1], [u for u in units if int(u[4:]) % 10 != 3]]):
        write_wide(wide.where(F.col("time") % 3 == part).select("time", *[F.expr(f"`{u}`") for u in names]), path)
    return unit_means(read_wide_long(spark, path)[0], digits=6)


def q30_saved_pipeline_predictions(spark, sf_dir):
    """A pipeline with group statistics, saved, loaded and applied without the training frame."""
    train, test = _train_test(spark, sf_dir)
    stages = [GroupStatistics(inputCols=["user"]), VectorAssembler(inputCols=["user_mean"], outputCol="x"),
              LinearRegression(featuresCol="x", labelCol="label", solver="normal", standardization=False)]
    path = scratch_path(spark, "q30-pipeline")
    Pipeline(stages=stages).fit(train.withColumn(OWN_COL, F.lit(True))).save(path)
    return PipelineModel.load(path).transform(test.drop("label")).select(
        "job_id", F.col("user_rows").cast("long").alias("user_rows"), F.round("prediction", 4).alias("prediction"))


# Two correlated columns: their covariance matrix has closed-form axes.
PCA_FEATURES = FeatureSpec(label="queue", numeric=("node_num", "cpu_num"), categorical=(), grouped=(), pca_k=2)
SLOT_FEATURES = FeatureSpec(label="queue", numeric=("node_num", "gpu_num"), categorical=("task_type",), grouped=(), pca_k=None)


def q31_pca_loadings(spark, sf_dir):
    """PCA axes of two scaled columns: loadings and shares of the variance."""
    train, _ = _train_test(spark, sf_dir)
    return pca_loadings(fit_features(train, PCA_FEATURES), PCA_FEATURES.numeric)


def q32_feature_slots(spark, sf_dir):
    """Non-zero slots of the assembled feature vectors (scaled numbers and one-hot types), named by their metadata."""
    train, _ = _train_test(spark, sf_dir)
    slots = feature_slots(fit_features(train, SLOT_FEATURES).transform(train))
    return slots.withColumn("value", F.round("value", 6))


def q33_permutation_importance(spark, sf_dir):
    """How much a one-feature model's error grows when the feature's values are dealt to other test rows."""
    train, test = _train_test(spark, sf_dir)
    both = Pipeline(stages=[VectorAssembler(inputCols=["gpu_use_count"], outputCol="x"),
                            LinearRegression(featuresCol="x", labelCol="label", solver="normal", standardization=False)])
    model = both.fit(train.select("gpu_use_count", "label"))
    return permutation_importance(test.select("job_id", "gpu_use_count", "cpu_num", "label"), model.transform,
                                  ["gpu_use_count", "cpu_num"], digits=4)


def q34_exact_sample(spark, sf_dir):
    """Exactly 500 jobs, those with the lowest salted hash of their id (a sampling operator)."""
    return exact_sample(jobs_e(spark, sf_dir).select("job_id", "cluster"), "job_id", 500, SAMPLE_SEED)


def q35_registry_in_one_scan(spark, sf_dir):
    """State shares of both clusters' CSV exports, read by one scan; the cluster comes from the file path."""
    path = scratch_path(spark, "q35-exports")
    jobs_from_orders(load(spark, sf_dir, "orders")).write.partitionBy("cluster").option("header", "true").csv(path)
    raw = read_registry(spark, {c: f"{path}/cluster={c}" for c in ("A", "B")})
    return state_shares(normalize_jobs(raw), by=["cluster"])


JOB_EXPORT = ("job_id", "user", "cluster", "task_type", "state", "gpu_time")


def q36_quarantined_export(spark, sf_dir):
    """An export with planted bad lines: rows and GPU time of the good ones per state, bad ones per reason."""
    path = scratch_path(spark, "q36-export")
    jobs = jobs_from_orders(load(spark, sf_dir, "orders")).selectExpr(
        *[f"CAST({c} AS string) AS {c}" for c in JOB_EXPORT if c != "gpu_time"],
        "CASE WHEN job_id % 50 = 2 THEN 'n/a' ELSE CAST(gpu_time AS string) END AS gpu_time", "job_id % 50 AS kind")
    jobs.where("kind > 1").drop("kind").write.csv(path)
    fields = f"concat_ws(',', {', '.join(JOB_EXPORT)}"
    jobs.where("kind <= 1").selectExpr(f"CASE kind WHEN 0 THEN {fields}, 'more') ELSE concat_ws(',', job_id, user) END AS value") \
        .write.mode("append").text(path)
    good, bad = quarantine(spark, path, JOB_EXPORT, scratch_path(spark, "q36-parsed"), numeric=["gpu_time"], header=False)
    counted = normalize_jobs(good).groupBy(F.col("state_label").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("gpu_time").cast("decimal(18,2)")).cast("double").alias("gpu_time"))
    found = bad_record_counts(bad).groupBy("reason").agg(F.sum("n").alias("n"))
    return counted.selectExpr("'good' AS kind", "name", "n", "gpu_time").unionByName(
        found.selectExpr("'bad' AS kind", "reason AS name", "n", "0.0D AS gpu_time"))


def q37_rewritten_cluster(spark, sf_dir):
    """A result table per cluster of which one cluster is written again, from Eval jobs alone; the other stays."""
    jobs, path = jobs_o(spark, sf_dir), scratch_path(spark, "q37-shares")
    write_result(state_shares(jobs, by=["cluster"]), path)
    again = state_shares(jobs.where("cluster = 'B' AND task_type = 'Eval'"), by=["cluster"])
    write_result(again, path, mode="overwrite_partitions")
    return spark.read.parquet(path).select(again.columns)


def q38_occupancy_in_two_steps(spark, sf_dir):
    """GPUs in use when the log's second half is added to the first half's stored state."""
    jobs = jobs_e(spark, sf_dir)
    lo, hi = jobs.agg(F.min("start_us"), F.max("start_us")).first()
    cut, state, tables = (0 if lo is None else (lo + hi) // 2), None, []
    for part, until in ((jobs.where(F.col("start_us") < cut), cut), (jobs.where(F.col("start_us") >= cut), None)):
        rows, state = occupancy_step(part, until, state)
        for kind, df in (("rows", rows), ("state", state)):
            path = scratch_path(spark, f"q38-{kind}")
            df.write.parquet(path)
            stored = spark.read.schema(df.schema).parquet(path)
            if kind == "rows":
                tables.append(stored)
            else:
                state = stored
    return tables[0].unionByName(tables[1]).select("cluster", "t", "gpus_in_use")


def q39_gpus_in_use_per_job(spark, sf_dir):
    """GPUs used by others when each job starts, from a trace with submit time, queue delay and duration only."""
    jobs = jobs_e(spark, sf_dir).selectExpr("job_id", "cluster", "timestamp_micros(submit_us) AS submit_time", "queue", "duration", "gpu_num")
    jobs = with_intervals(jobs)
    return gpus_in_use_at(jobs, gpu_occupancy(jobs)).select("job_id", "start_us", "end_us", "gpus_in_use")


# ------------------------------------------------------------ oracle SQL

_JOBS_O = """
jobs_o AS (
  SELECT o_orderkey AS job_id, o_custkey AS "user",
         CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS cluster,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Eval' WHEN '5-LOW' THEN 'Pretrain'
              ELSE 'Other' END AS task_type,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'CANCELED'
              WHEN 'P' THEN 'FAILED' END AS state,
         o_totalprice AS gpu_time
  FROM orders),
jo AS (
  SELECT *, CASE state WHEN 'COMPLETED' THEN 'Completed' WHEN 'CANCELED' THEN 'Canceled'
                       WHEN 'FAILED' THEN 'Failed' ELSE 'Unknown' END AS state_label
  FROM jobs_o)"""

_JOBS_E = """
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
jobs_e AS (
  SELECT event_id AS job_id, user_id AS "user",
         CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS cluster,
         CASE event_type WHEN 'click' THEN 'Eval' WHEN 'view' THEN 'Pretrain'
              ELSE 'Other' END AS task_type,
         ['COMPLETED', 'CANCELED', 'FAILED', 'TIMEOUT', 'NODE_FAIL'][k % 5 + 1] AS state,
         value AS queue, k AS gpu_use_count,
         CAST(k % 8 + 1 AS DOUBLE) AS gpu_num, CAST(k % 4 + 1 AS DOUBLE) AS node_num,
         CAST((k % 16 + 1) * 8 AS DOUBLE) AS cpu_num, CAST((k + 1) * 60 AS DOUBLE) AS duration,
         epoch_us(ts) AS submit_us,
         epoch_us(ts) + CAST(round(value * 1000000.0) AS BIGINT) AS start_us,
         epoch_us(ts) + CAST(round(value * 1000000.0) AS BIGINT) + (k + 1) * 60 * 1000000 AS end_us
  FROM ev),
je AS (
  SELECT *, CASE state WHEN 'COMPLETED' THEN 'Completed' WHEN 'CANCELED' THEN 'Canceled'
                       WHEN 'FAILED' THEN 'Failed' ELSE 'Unknown' END AS state_label
  FROM jobs_e)"""

_LABELS = """
labels AS (
  SELECT * FROM (VALUES ('Completed', 0), ('Canceled', 1), ('Failed', 2), ('Unknown', 3))
         AS t(state, state_order))"""


def _pct(part: str, whole: str) -> str:
    return (f"coalesce(CAST({part} AS DOUBLE) * 100.0 / "
            f"NULLIF(CAST({whole} AS DOUBLE), 0), 0.0)")


def _share_sql(src_ctes: str, src: str, by=(), weight=None, extra_where="") -> str:
    by = list(by)
    gb = "".join(f"{b}, " for b in by)
    on = "".join(f" AND c.{b} = g.{b}" for b in by)
    gsel = "".join(f"g.{b}, " for b in by)
    w_c = f", sum(CAST({weight} AS DECIMAL(18,2))) AS w" if weight else ""
    w_g = (", sum(w) AS w_total, sum(w) FILTER (WHERE state <> 'Unknown') AS w_known"
           if weight else "")
    m, mt, mk = ("c.w", "g.w_total", "g.w_known") if weight else ("c.n", "g.n_total", "g.n_known")
    w_out = f"CAST(coalesce(c.w, 0) AS DOUBLE) AS {weight}, " if weight else ""
    where = f"WHERE {extra_where}" if extra_where else ""
    return f"""WITH {src_ctes},{_LABELS},
c AS (SELECT {gb}state_label AS state, count(*) AS n{w_c} FROM {src} {where} GROUP BY ALL),
g AS (SELECT {gb}sum(n) AS n_total, sum(n) FILTER (WHERE state <> 'Unknown') AS n_known{w_g}
      FROM c GROUP BY ALL)
SELECT {gsel}l.state, l.state_order, CAST(coalesce(c.n, 0) AS BIGINT) AS n_jobs, {w_out}
       {_pct(f'coalesce({m}, 0)', mt)} AS pct_of_all,
       CASE WHEN l.state = 'Unknown' THEN NULL
            ELSE {_pct(f'coalesce({m}, 0)', f'coalesce({mk}, 0)')} END AS pct_of_known
FROM g CROSS JOIN labels l LEFT JOIN c ON c.state = l.state{on}"""


def _bin_sql(x: str, lo: float, hi: float, w: float, overflow: bool) -> str:
    n = int(round((hi - lo) / w))
    over = str(n) if overflow else "NULL"
    return (f"CASE WHEN {x} IS NULL OR {x} < {lo} THEN NULL WHEN {x} > {hi} THEN {over} "
            f"WHEN {x} = {hi} THEN {n - 1} ELSE CAST(floor(({x} - {lo}) / {w}) AS INTEGER) END")


def _label_sql(b: str, lo: int, hi: int, w: int, overflow: str | None) -> str:
    n = (hi - lo) // w
    arms = " ".join(f"WHEN {i} THEN '{lo + i * w}-{lo + (i + 1) * w}'" for i in range(n))
    if overflow:
        arms += f" WHEN {n} THEN '{overflow}'"
    return f"CASE {b} {arms} ELSE 'Unknown' END"


def _mean_sql(v: str, scale: int = 2) -> str:
    return (f"CAST(sum(CAST({v} AS DECIMAL(18,{scale}))) AS DOUBLE) / "
            f"CAST(count({v}) AS DOUBLE)")


_GPU_BIN = _bin_sql("gpu_use_count", 0, 80, 10, False)
_GPU_LABEL = _label_sql("bin", 0, 80, 10, None)
_Q_BIN = _bin_sql("queue", 0, 300, 20, True)
_Q_LABEL = _label_sql("bin", 0, 300, 20, ">300")

ORACLE = {
    "q01_csv_ingest": f"""WITH {_JOBS_O}
SELECT state_label AS state, count(*) AS n_jobs,
       CAST(sum(CAST(gpu_time AS DECIMAL(18,2))) AS DOUBLE) AS gpu_time
FROM jo GROUP BY state_label""",
    "q02_state_share": _share_sql(_JOBS_O, "jo"),
    "q03_state_share_by_cluster": _share_sql(_JOBS_O, "jo", by=["cluster"]),
    "q03b_state_share_from_cluster_exports": _share_sql(_JOBS_O, "jo", by=["cluster"]),
    "q04_gpu_time_by_state": f"""SELECT state, state_order, gpu_time FROM (
{_share_sql(_JOBS_O, "jo", weight="gpu_time")})""",
    "q05_gpu_time_share_by_cluster": _share_sql(_JOBS_O, "jo", by=["cluster"], weight="gpu_time"),
    "q06_state_share_by_type": _share_sql(_JOBS_O, "jo", by=["task_type"],
                                          extra_where="task_type IN ('Eval', 'Pretrain')"),
    "q07_known_state_share": _share_sql(_JOBS_E, "je", by=["cluster", "task_type"]),
    "q08_queue_by_gpu_bin": f"""WITH {_JOBS_E}
SELECT coalesce(bin, -1) AS bin, n_jobs, mean_queue, {_GPU_LABEL} AS label FROM (
  SELECT {_GPU_BIN} AS bin, count(*) AS n_jobs, {_mean_sql('queue')} AS mean_queue
  FROM je WHERE task_type = 'Eval' GROUP BY 1)""",
    "q08c_discount_by_quantity_bin": f"""
SELECT coalesce(bin, -1) AS bin, n_jobs, mean_discount, {_label_sql('bin', 0, 50, 10, None)} AS label FROM (
  SELECT {_bin_sql('l_quantity', 0, 50, 10, False)} AS bin, count(*) AS n_jobs,
         {_mean_sql('discount', 4)} AS mean_discount
  FROM (SELECT l_quantity, l_extendedprice * l_discount AS discount FROM lineitem) GROUP BY 1)""",
    "q08b_queue_by_gpu_bin_per_cluster": f"""WITH {_JOBS_E}
SELECT cluster, coalesce(bin, -1) AS bin, n_jobs, mean_queue,
       CASE cluster WHEN 'A' THEN {_label_sql('bin', 0, 80, 10, None)}
                    ELSE {_label_sql('bin', 0, 100, 25, None)} END AS label
FROM (
  SELECT cluster,
         CASE cluster WHEN 'A' THEN {_bin_sql('gpu_use_count', 0, 80, 10, False)}
                      ELSE {_bin_sql('gpu_use_count', 0, 100, 25, False)} END AS bin,
         count(*) AS n_jobs, {_mean_sql('queue')} AS mean_queue
  FROM je WHERE task_type = 'Eval' GROUP BY 1, 2)""",
    "q09_queue_by_gpu_bin_and_type": f"""WITH {_JOBS_E}
SELECT task_type, coalesce(bin, -1) AS bin, n_jobs, mean_queue, {_GPU_LABEL} AS label FROM (
  SELECT task_type, {_GPU_BIN} AS bin, count(*) AS n_jobs, {_mean_sql('queue')} AS mean_queue
  FROM je WHERE task_type IN ('Eval', 'Pretrain') GROUP BY 1, 2)""",
    "q10_queue_bins_all_states": f"""WITH {_JOBS_E}
SELECT coalesce(bin, -1) AS bin, n_jobs, {_Q_LABEL} AS label FROM (
  SELECT {_Q_BIN} AS bin, count(*) AS n_jobs FROM je GROUP BY 1)""",
    "q11_cancels_by_queue_bin": f"""WITH {_JOBS_E}
SELECT coalesce(bin, -1) AS bin, n_jobs, {_Q_LABEL} AS label FROM (
  SELECT {_Q_BIN} AS bin, count(*) AS n_jobs FROM je
  WHERE task_type = 'Eval' AND state_label = 'Canceled' GROUP BY 1)""",
    "q12_unsuccessful_breakdown": f"""WITH {_JOBS_O},
a AS (
  SELECT cluster, count(*) AS n_jobs,
         count(*) FILTER (WHERE state_label <> 'Completed') AS n_unsuccessful,
         count(*) FILTER (WHERE state_label = 'Canceled') AS n_canceled,
         coalesce(sum(CAST(gpu_time AS DECIMAL(18,2))), 0) AS g_all,
         coalesce(sum(CAST(gpu_time AS DECIMAL(18,2))) FILTER (WHERE state_label <> 'Completed'), 0) AS g_bad,
         coalesce(sum(CAST(gpu_time AS DECIMAL(18,2))) FILTER (WHERE state_label = 'Canceled'), 0) AS g_cancel
  FROM jo GROUP BY cluster)
SELECT cluster, n_jobs, n_unsuccessful, n_canceled,
       CAST(g_all AS DOUBLE) AS gpu_time_all, CAST(g_bad AS DOUBLE) AS gpu_time_unsuccessful,
       CAST(g_cancel AS DOUBLE) AS gpu_time_canceled,
       {_pct('n_unsuccessful', 'n_jobs')} AS pct_unsuccessful,
       {_pct('n_canceled', 'n_unsuccessful')} AS pct_canceled_of_unsuccessful,
       {_pct('CAST(g_cancel AS DOUBLE)', 'CAST(g_bad AS DOUBLE)')} AS pct_gpu_time_canceled_of_unsuccessful
FROM a""",
}

_LINE_MEANS = """
u AS (SELECT l_orderkey AS unit, round(avg(l_quantity * 2), 6) AS mean_util
      FROM lineitem GROUP BY l_orderkey)"""

_OCC = """
d AS (SELECT cluster, start_us AS t, CAST(gpu_num AS BIGINT) AS d FROM jobs_e
      UNION ALL SELECT cluster, end_us AS t, -CAST(gpu_num AS BIGINT) AS d FROM jobs_e),
n AS (SELECT cluster, t, sum(d) AS delta FROM d GROUP BY cluster, t),
occ AS (SELECT cluster, t, CAST(sum(delta) OVER (PARTITION BY cluster ORDER BY t
                                ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gpus_in_use FROM n)"""

_OCC_SUBMIT = """
ds AS (SELECT cluster, start_us AS t, CAST(gpu_num AS BIGINT) AS d FROM jobs_e
       UNION ALL SELECT cluster, end_us AS t, -CAST(gpu_num AS BIGINT) AS d FROM jobs_e
       UNION ALL SELECT cluster, submit_us AS t, CAST(0 AS BIGINT) AS d FROM jobs_e),
ns AS (SELECT cluster, t, sum(d) AS delta FROM ds GROUP BY cluster, t),
occs AS (SELECT cluster, t, CAST(sum(delta) OVER (PARTITION BY cluster ORDER BY t
                                 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gpus_in_use FROM ns)"""

_U_BIN = _bin_sql("mean_util", 0, 100, 10, False)

ORACLE.update({
    "q13_unit_mean_util": """
SELECT 'col_' || CAST(i AS VARCHAR) AS unit, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean_util
FROM embeddings CROSS JOIN (SELECT unnest(range(1, max(len(embedding)) + 1)) AS i FROM embeddings) GROUP BY i""",
    "q13c_wide_exports_with_other_headers": """
SELECT 'gpu-' || CAST(i AS VARCHAR) AS unit, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean_util
FROM embeddings CROSS JOIN (SELECT unnest(range(1, max(len(embedding)) + 1)) AS i FROM embeddings)
WHERE NOT (vec_id % 3 = 2 AND i % 10 = 3) GROUP BY i""",
    "q13b_unit_mean_util_daily": """
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT event_type AS unit, round(avg(v), 6) AS mean_util FROM d GROUP BY event_type""",
    "q14_util_histogram": f"""WITH {_LINE_MEANS},
s0 AS (SELECT min(mean_util) AS mn, max(mean_util) AS mx FROM u),
s AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
             CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM s0),
e AS (SELECT CAST(i AS INTEGER) AS bin,
             CASE WHEN i = 10 THEN hi ELSE CAST(i AS DOUBLE) * ((hi - lo) / 10.0) + lo END AS edge
      FROM s CROSS JOIN range(11) AS r(i)),
r0 AS (SELECT mean_util AS x, least(CAST(floor((mean_util - lo) * (10.0 / (hi - lo))) AS INTEGER), 9) AS b
       FROM u CROSS JOIN s WHERE mean_util IS NOT NULL),
r1 AS (SELECT r0.x, CASE WHEN r0.x < e.edge THEN r0.b - 1 ELSE r0.b END AS b
       FROM r0 JOIN e ON e.bin = r0.b),
r2 AS (SELECT CASE WHEN r1.x >= e.edge AND r1.b <> 9 THEN r1.b + 1 ELSE r1.b END AS bin
       FROM r1 JOIN e ON e.bin = r1.b + 1),
c AS (SELECT bin, count(*) AS n FROM r2 GROUP BY bin)
SELECT e.bin, e.edge AS bin_lo, e1.edge AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM e JOIN e AS e1 ON e1.bin = e.bin + 1 LEFT JOIN c ON c.bin = e.bin""",
    "q15_util_bands": f"""WITH {_LINE_MEANS},
h AS (SELECT {_U_BIN} AS bin, 1 AS w FROM u
      UNION ALL SELECT CAST(i AS INTEGER), 0 FROM range(10) AS r(i)),
c AS (SELECT bin, CAST(sum(w) AS BIGINT) AS n_units FROM h GROUP BY bin)
SELECT bin, {_label_sql('bin', 0, 100, 10, None)} AS label,
       CASE WHEN bin IS NULL THEN 'unclassified'
            WHEN bin * 10 >= 0 AND bin * 10 < 20 THEN 'low'
            WHEN bin * 10 >= 20 AND bin * 10 < 60 THEN 'mid'
            WHEN bin * 10 >= 70 AND bin * 10 < 100 THEN 'high'
            ELSE 'unclassified' END AS zone,
       n_units
FROM c""",
    "q16_gpu_occupancy": f"""WITH {_JOBS_E},{_OCC}
SELECT cluster, t, gpus_in_use FROM occ""",
    "q16b_occupancy_of_odd_jobs": f"""WITH {_JOBS_E},
j AS (
  SELECT CASE WHEN gpu_use_count % 5 > 0 THEN cluster ELSE 'none' END AS cluster, start_us, CAST(gpu_num AS BIGINT) AS g,
         CASE WHEN gpu_use_count % 11 = 0 THEN NULL WHEN gpu_use_count % 7 = 0 THEN start_us
              WHEN gpu_use_count % 13 = 0 THEN start_us - 1000000 ELSE end_us END AS end_us
  FROM je),
held AS (SELECT * FROM j WHERE end_us IS NULL OR start_us < end_us),
i AS (SELECT cluster, start_us AS t FROM j UNION SELECT cluster, end_us FROM held WHERE end_us IS NOT NULL)
SELECT i.cluster, i.t, CAST(coalesce(sum(h.g), 0) AS BIGINT) AS gpus_in_use
FROM i LEFT JOIN held h ON h.cluster = i.cluster AND h.start_us <= i.t AND i.t < coalesce(h.end_us, 9223372036854775807)
GROUP BY 1, 2""",
    "q17_queue_by_occupancy": f"""WITH {_JOBS_E},{_OCC},
p AS (SELECT je.*, occ.gpus_in_use - CAST(je.gpu_num AS BIGINT) AS in_use
      FROM je LEFT JOIN occ ON occ.cluster = je.cluster AND occ.t = je.start_us)
SELECT task_type, coalesce(bin, -1) AS bin, n_jobs, mean_queue, {_label_sql('bin', 0, 80, 10, None)} AS label FROM (
  SELECT task_type, {_bin_sql('in_use', 0, 80, 10, False)} AS bin, count(*) AS n_jobs,
         {_mean_sql('queue')} AS mean_queue
  FROM p WHERE task_type IN ('Eval', 'Pretrain') GROUP BY 1, 2)""",
    "q17b_queue_by_occupancy_at_submit": f"""WITH {_JOBS_E},{_OCC_SUBMIT},
p AS (SELECT je.*, occs.gpus_in_use - CASE WHEN je.start_us = je.submit_us
                                           THEN CAST(je.gpu_num AS BIGINT) ELSE 0 END AS in_use
      FROM je LEFT JOIN occs ON occs.cluster = je.cluster AND occs.t = je.submit_us)
SELECT task_type, coalesce(bin, -1) AS bin, n_jobs, mean_queue, {_label_sql('bin', 0, 80, 10, None)} AS label FROM (
  SELECT task_type, {_bin_sql('in_use', 0, 80, 10, False)} AS bin, count(*) AS n_jobs,
         {_mean_sql('queue')} AS mean_queue
  FROM p WHERE task_type IN ('Eval', 'Pretrain') GROUP BY 1, 2)""",
})

_THRESHOLD = int(round(TRAIN_FRACTION * HASH_SPACE))
_SPLIT = (f"CASE WHEN CAST('0x' || substr(md5('{SPLIT_SEED}:' || CAST(job_id AS VARCHAR)), 1, 8) "
          f"AS BIGINT) < {_THRESHOLD} THEN 'train' ELSE 'test' END")
_TRAIN = f"""
tr AS (
  SELECT CAST(job_id AS VARCHAR) AS job_id, CAST("user" AS VARCHAR) AS "user", task_type,
         node_num, gpu_num, cpu_num, duration, queue, gpu_use_count, queue AS label,
         {_SPLIT} AS split
  FROM je
  WHERE state = 'COMPLETED' AND node_num IS NOT NULL AND gpu_num IS NOT NULL
    AND cpu_num IS NOT NULL AND duration IS NOT NULL AND queue IS NOT NULL)"""


def _scaled(c: str) -> str:
    return (f"CASE WHEN max_{c} = min_{c} THEN CAST(0.5 AS DOUBLE) "
            f"ELSE ({c} - min_{c}) * (CAST(1.0 AS DOUBLE) / (max_{c} - min_{c})) + 0.0 END "
            f"AS {c}_scaled")


_NUM = ("node_num", "gpu_num", "cpu_num", "duration")
_TRAIN_MEAN = ("CAST(sum(CAST(label AS DECIMAL(18,2))) AS DOUBLE) / "
               "CAST(count(label) AS DOUBLE)")

ORACLE.update({
    "q18_training_rows": f"""WITH {_JOBS_E},{_TRAIN}
SELECT job_id, "user", task_type, node_num, gpu_num, cpu_num, duration, queue, label FROM tr""",
    "q19_hash_split": f"""WITH {_JOBS_E}
SELECT CAST(job_id AS VARCHAR) AS job_id, {_SPLIT} AS split FROM jobs_e""",
    "q20_minmax_features": f"""WITH {_JOBS_E},{_TRAIN},
s AS (SELECT {", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in _NUM)}
      FROM tr WHERE split = 'train')
SELECT job_id, {", ".join(_scaled(c) for c in _NUM)}
FROM tr CROSS JOIN s WHERE split = 'train'""",
    "q21_string_index": f"""WITH {_JOBS_E},{_TRAIN},
t AS (SELECT * FROM tr WHERE split = 'train'),
cu AS (SELECT "user" AS v, count(*) AS c FROM t GROUP BY 1),
iu AS (SELECT v, CAST(row_number() OVER (ORDER BY c DESC, v) - 1 AS DOUBLE) AS idx FROM cu),
ct AS (SELECT task_type AS v, count(*) AS c FROM t GROUP BY 1),
it AS (SELECT v, CAST(row_number() OVER (ORDER BY c DESC, v) - 1 AS DOUBLE) AS idx FROM ct)
SELECT t.job_id, iu.idx AS user_index, it.idx AS task_type_index
FROM t JOIN iu ON iu.v = t."user" JOIN it ON it.v = t.task_type""",
    "q22_baseline_metrics": f"""WITH {_JOBS_E},{_TRAIN},
m AS (SELECT task_type, {_TRAIN_MEAN} AS pred FROM tr WHERE split = 'train' GROUP BY 1),
g AS (SELECT {_TRAIN_MEAN} AS gpred FROM tr WHERE split = 'train'),
p AS (SELECT t.label, coalesce(m.pred, g.gpred) AS prediction
      FROM tr t LEFT JOIN m ON m.task_type = t.task_type CROSS JOIN g WHERE t.split = 'test')
SELECT count(*) AS n_test,
       round(sqrt(avg((prediction - label) * (prediction - label))), 6) AS rmse,
       round(avg(abs(prediction - label)), 6) AS mae
FROM p""",
    "q27_preview": f"""WITH {_JOBS_O}
SELECT CAST(job_id AS VARCHAR) AS job_id, state, gpu_time FROM jobs_o
ORDER BY gpu_time DESC, CAST(job_id AS VARCHAR) LIMIT 20""",
    "q28_result_table": ORACLE["q03_state_share_by_cluster"],
    "q29_hash_sample": f"""WITH {_JOBS_E}
SELECT CAST(job_id AS VARCHAR) AS job_id FROM jobs_e
WHERE CAST('0x' || substr(md5('{SAMPLE_SEED}:' || CAST(job_id AS VARCHAR)), 1, 8) AS BIGINT) < {int(round(0.1 * HASH_SPACE))}""",
    "q26_stump_metrics": f"""WITH {_JOBS_E},{_TRAIN},
g AS (SELECT node_num AS v, count(*) AS n, sum(label) AS s FROM tr WHERE split = 'train' GROUP BY 1),
cuts AS (
  SELECT a.v AS cut, sum(CASE WHEN g.v <= a.v THEN g.n ELSE 0 END) AS nl, sum(CASE WHEN g.v <= a.v THEN g.s ELSE 0 END) AS sl,
         sum(g.n) AS n, sum(g.s) AS s
  FROM g a CROSS JOIN g GROUP BY a.v),
best AS (
  SELECT cut, sl / nl AS low, (s - sl) / (n - nl) AS high FROM cuts WHERE nl < n
  ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, cut LIMIT 1),
p AS (SELECT label, CASE WHEN node_num <= cut THEN low ELSE high END AS prediction
      FROM tr CROSS JOIN best WHERE split = 'test'),
m AS (SELECT count(*) AS n, sqrt(avg((prediction - label) * (prediction - label))) AS rmse,
             avg(abs(prediction - label)) AS mae FROM p)
SELECT model, metric, CASE metric WHEN 'rmse' THEN round(rmse, 6) WHEN 'mae' THEN round(mae, 6)
                                  ELSE CAST(n AS DOUBLE) END AS value
FROM m CROSS JOIN (VALUES ('one_tree'), ('one_round')) AS a(model)
       CROSS JOIN (VALUES ('rmse'), ('mae'), ('n_test')) AS b(metric)""",
    "q23_linear_one_feature": f"""WITH {_JOBS_E},{_TRAIN}
SELECT round(regr_slope(label, gpu_use_count), 6) AS slope,
       round(regr_intercept(label, gpu_use_count), 6) AS intercept
FROM tr WHERE split = 'train'""",
})

_HASHED = "md5('{}:' || CAST(job_id AS VARCHAR))"
_PCA = """
c AS (SELECT var_samp(node_num_scaled) AS a, covar_samp(node_num_scaled, cpu_num_scaled) AS b, var_samp(cpu_num_scaled) AS d FROM x),
l AS (SELECT *, (a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2 AS l1, (a + d - sqrt((a - d) * (a - d) + 4 * b * b)) / 2 AS l2 FROM c),
v AS (SELECT 'pc1' AS axis, b AS p, l1 - a AS r, l1 / (a + d) AS share FROM l UNION ALL SELECT 'pc2', b, l2 - a, l2 / (a + d) FROM l),
u AS (SELECT axis, p / sqrt(p * p + r * r) AS p, r / sqrt(p * p + r * r) AS r, share FROM v),
s AS (SELECT axis, share, CASE WHEN (abs(p) >= abs(r) AND p < 0) OR (abs(p) < abs(r) AND r < 0) THEN -1 ELSE 1 END AS sign, p, r FROM u)
SELECT axis, 'node_num' AS feature, round(sign * p, 6) AS loading, round(share, 6) AS explained FROM s
UNION ALL SELECT axis, 'cpu_num', round(sign * r, 6), round(share, 6) FROM s"""


def _dealt_sql(column: str) -> str:
    """RMSE of the line over gpu_use_count with the values of ``column`` dealt to other test rows."""
    x = "b.value" if column == "gpu_use_count" else "t.gpu_use_count"
    return f"""
SELECT '{column}' AS feature, sqrt(avg((m.a * {x} + m.b - t.label) * (m.a * {x} + m.b - t.label))) AS r
FROM te t JOIN r1 ON r1.job_id = t.job_id JOIN (SELECT i, {column} AS value FROM r2) b ON b.i = r1.i CROSS JOIN m"""


ORACLE.update({
    "q30_saved_pipeline_predictions": f"""WITH {_JOBS_E},{_TRAIN},
s AS (SELECT "user" AS u, count(*) AS n, sum(label) AS s FROM tr WHERE split = 'train' GROUP BY 1),
g AS (SELECT avg(label) AS g FROM tr WHERE split = 'train'),
x AS (SELECT label, CASE WHEN n > 1 THEN (s - label) / (n - 1) ELSE g END AS x
      FROM tr JOIN s ON u = "user" CROSS JOIN g WHERE split = 'train'),
f AS (SELECT regr_slope(label, x) AS a, regr_intercept(label, x) AS b FROM x)
SELECT job_id, coalesce(n, 0) AS user_rows, round(a * coalesce(s / n, g) + b, 4) AS prediction
FROM tr LEFT JOIN s ON u = "user" CROSS JOIN g CROSS JOIN f WHERE split = 'test'""",
    "q31_pca_loadings": f"""WITH {_JOBS_E},{_TRAIN},
m AS (SELECT {", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in ("node_num", "cpu_num"))} FROM tr WHERE split = 'train'),
x AS (SELECT {_scaled("node_num")}, {_scaled("cpu_num")} FROM tr CROSS JOIN m WHERE split = 'train'),{_PCA}""",
    "q32_feature_slots": f"""WITH {_JOBS_E},{_TRAIN},
t AS (SELECT * FROM tr WHERE split = 'train'),
m AS (SELECT {", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in ("node_num", "gpu_num"))} FROM t),
k AS (SELECT task_type, row_number() OVER (ORDER BY count(*) DESC, task_type) - 1 AS i FROM t GROUP BY 1),
x AS (SELECT job_id, task_type, {_scaled("node_num")}, {_scaled("gpu_num")} FROM t CROSS JOIN m)
SELECT job_id, 0 AS slot, 'scaled_numeric_0' AS name, round(node_num_scaled, 6) AS value FROM x WHERE node_num_scaled <> 0
UNION ALL SELECT job_id, 1, 'scaled_numeric_1', round(gpu_num_scaled, 6) FROM x WHERE gpu_num_scaled <> 0
UNION ALL SELECT job_id, CAST(2 + i AS INTEGER), 'task_type_vec_' || task_type, CAST(1 AS DOUBLE) FROM x JOIN k USING (task_type)""",
    "q33_permutation_importance": f"""WITH {_JOBS_E},{_TRAIN},
m AS (SELECT regr_slope(label, gpu_use_count) AS a, regr_intercept(label, gpu_use_count) AS b FROM tr WHERE split = 'train'),
te AS (SELECT job_id, gpu_use_count, cpu_num, label FROM tr WHERE split = 'test'),
r1 AS (SELECT job_id, row_number() OVER (ORDER BY {_HASHED.format(42)}, job_id) AS i FROM te),
r2 AS (SELECT *, row_number() OVER (ORDER BY {_HASHED.format(43)}, job_id) AS i FROM te),
d AS ({_dealt_sql("gpu_use_count")} UNION ALL {_dealt_sql("cpu_num")}),
e AS (SELECT sqrt(avg((a * gpu_use_count + b - label) * (a * gpu_use_count + b - label))) AS r FROM te CROSS JOIN m)
SELECT feature, round(e.r, 4) AS rmse, round(d.r, 4) AS rmse_permuted, round(d.r - e.r, 4) + 0.0 AS importance FROM d CROSS JOIN e""",
    "q40_two_level_tree_metrics": f"""WITH {_JOBS_E},{_TRAIN},
v AS (SELECT job_id, split, label, 0 AS f, node_num AS x FROM tr UNION ALL SELECT job_id, split, label, 1, cpu_num FROM tr),
g0 AS (SELECT f, x, count(*) AS n, sum(label) AS s FROM v WHERE split = 'train' GROUP BY 1, 2),
c0 AS (SELECT f, x AS cut, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS s
       FROM g0 WINDOW w AS (PARTITION BY f ORDER BY x)),
b0 AS (SELECT f, cut FROM c0 WHERE nl < n ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, f, cut LIMIT 1),
d AS (SELECT job_id, x <= cut AS side FROM v JOIN b0 USING (f)),
g1 AS (SELECT side, f, x, count(*) AS n, sum(label) AS s FROM v JOIN d USING (job_id) WHERE split = 'train' GROUP BY 1, 2, 3),
c1 AS (SELECT side, f, x AS cut, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY side, f) AS n,
              sum(s) OVER (PARTITION BY side, f) AS s FROM g1 WINDOW w AS (PARTITION BY side, f ORDER BY x)),
b1 AS (SELECT side, f, cut FROM c1 WHERE nl < n
       QUALIFY row_number() OVER (PARTITION BY side ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, f, cut) = 1),
l AS (SELECT v.job_id, split, label, d.side, coalesce(x <= cut, true) AS low FROM v JOIN d USING (job_id) LEFT JOIN b1 ON b1.side = d.side
      WHERE v.f = coalesce(b1.f, 0)),
p AS (SELECT t.label, m.p AS prediction FROM l t JOIN (SELECT side, low, avg(label) AS p FROM l WHERE split = 'train' GROUP BY 1, 2) m
      ON m.side = t.side AND m.low = t.low WHERE t.split = 'test'),
m AS (SELECT count(*) AS n, sqrt(avg((prediction - label) * (prediction - label))) AS rmse, avg(abs(prediction - label)) AS mae FROM p)
SELECT model, metric, CASE metric WHEN 'rmse' THEN round(rmse, 6) WHEN 'mae' THEN round(mae, 6) ELSE CAST(n AS DOUBLE) END AS value
FROM m CROSS JOIN (VALUES ('one_tree'), ('one_round')) AS a(model) CROSS JOIN (VALUES ('rmse'), ('mae'), ('n_test')) AS b(metric)""",
    "q34_exact_sample": f"""WITH {_JOBS_E}
SELECT CAST(job_id AS VARCHAR) AS job_id, cluster FROM jobs_e ORDER BY {_HASHED.format(SAMPLE_SEED)}, 1 LIMIT 500""",
    "q35_registry_in_one_scan": ORACLE["q03_state_share_by_cluster"],
    "q36_quarantined_export": f"""WITH {_JOBS_O}
SELECT 'good' AS kind, state_label AS name, count(*) AS n, CAST(sum(CAST(gpu_time AS DECIMAL(18,2))) AS DOUBLE) AS gpu_time
FROM jo WHERE job_id % 50 > 2 GROUP BY 2
UNION ALL SELECT 'bad', CASE WHEN job_id % 50 < 2 THEN 'fields' ELSE 'number: gpu_time' END, count(*), CAST(0 AS DOUBLE)
FROM jo WHERE job_id % 50 <= 2 GROUP BY 2""",
    "q37_rewritten_cluster": f"""SELECT * FROM ({ORACLE["q03_state_share_by_cluster"]}) WHERE cluster = 'A'
UNION ALL SELECT * FROM ({_share_sql(_JOBS_O, "jo", by=["cluster"], extra_where="cluster = 'B' AND task_type = 'Eval'")})""",
    "q38_occupancy_in_two_steps": ORACLE["q16_gpu_occupancy"],
    "q39_gpus_in_use_per_job": f"""WITH {_JOBS_E},{_OCC}
SELECT CAST(job_id AS VARCHAR) AS job_id, start_us, end_us, occ.gpus_in_use - CAST(gpu_num AS BIGINT) AS gpus_in_use
FROM jobs_e LEFT JOIN occ ON occ.cluster = jobs_e.cluster AND occ.t = start_us""",
})

QUERIES: dict[str, Query] = {
    name: fn for name, fn in globals().items()
    if name[:1] == "q" and name[1:3].isdigit() and callable(fn)
}
