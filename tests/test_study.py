"""The study's reports end to end over CSV exports written from the test tables."""

import pytest

from jobscope.functions.binning import BinSpec
from jobscope.operators.ml import FeatureSpec, ModelSpec
from jobscope.operators.occupancy import gpu_occupancy, gpus_in_use_at
from jobscope.operators.shares import state_shares
from jobscope.plans import catalog as C
from jobscope.plans import study
from jobscope.session import scratch_path
from jobscope.sources.adapters import load, wide_from_embeddings

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def exports(spark):
    jobs = C.jobs_e(spark, SF_SMALL)
    tasks, trace = {}, {}
    for cl in ("A", "B"):
        part = jobs.where(f"cluster = '{cl}'")
        tasks[cl] = scratch_path(spark, f"tasks-{cl}")
        part.selectExpr("job_id", "task_type AS TaskType", "state AS TaskStatus",
                        "queue", "gpu_use_count AS GpuUseCount", "queue * gpu_num AS GPU_Time") \
            .write.option("header", "true").csv(tasks[cl])
        trace[cl] = scratch_path(spark, f"trace-{cl}")
        part.selectExpr("job_id", "user", "task_type AS type", "state", "node_num", "gpu_num",
                        "cpu_num",
                        "date_format(timestamp_micros(submit_us), 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
                        " AS submit_time", "queue", "duration") \
            .write.option("header", "true").csv(trace[cl])
    util = scratch_path(spark, "util")
    wide = wide_from_embeddings(load(spark, SF_SMALL, "embeddings"), width=8)
    wide.toDF("Time", *[f"gpu-{i}" for i in range(1, 9)]).write.option("header", "true").csv(util)
    return {"tasks": tasks, "trace": trace, "util": {"A": util}, "jobs": jobs}


def test_state_shares_from_csv(spark, exports):
    got = {(r.cluster, r.state): r.n_jobs
           for r in study.task_state_shares(spark, exports["tasks"]).collect()}
    want = {(r.cluster, r.state): r.n_jobs
            for r in state_shares(exports["jobs"], by=["cluster"]).collect()}
    assert got == want
    assert study.task_gpu_time_shares(spark, exports["tasks"]).count() == 8
    assert study.task_type_state_shares(spark, exports["tasks"]).count() == 16
    assert study.unsuccessful_jobs(spark, exports["tasks"]).count() == 2


def test_queue_reports(spark, exports):
    specs = {"A": BinSpec(0, 100, 50), "B": BinSpec(0, 100, 25)}
    out = study.queue_by_gpus_in_use(spark, exports["tasks"], specs).collect()
    assert {r.cluster for r in out} == {"A", "B"}
    assert sum(r.n_jobs for r in out) == exports["jobs"].where(
        "task_type IN ('Eval', 'Pretrain')").count()
    cancels = study.cancels_by_queue_delay(spark, exports["tasks"]).collect()
    assert sum(r.n_jobs for r in cancels) == exports["jobs"].where(
        "task_type = 'Eval' AND state = 'CANCELED'").count()


def test_unit_utilization(spark, exports):
    hist, bands = study.unit_utilization(spark, exports["util"])
    assert sum(r.n for r in hist.collect()) == 8
    assert sum(r.n_units for r in bands.collect()) == 8


def test_gpus_in_use_from_trace_matches_direct(spark, exports):
    got = {int(r.job_id): r.gpu_use_count
           for r in study.gpus_in_use(spark, exports["trace"]).collect()}
    jobs = exports["jobs"]
    want = {int(r.job_id): r.gpus_in_use
            for r in gpus_in_use_at(jobs, gpu_occupancy(jobs)).collect()}
    assert got == want


def test_duration_models(spark, exports):
    spec = FeatureSpec(label="duration", numeric=("node_num", "gpu_num", "cpu_num", "queue"),
                       categorical=("user", "task_type"), pca_k=3)
    metrics, imp = study.duration_models(
        spark, exports["trace"], spec,
        models=[ModelSpec("lr", {}), ModelSpec("rf", {"numTrees": 3, "maxDepth": 3, "seed": 1})])
    rows = {(r.model, r.metric): r.value for r in metrics.collect()}
    assert rows[("lr", "rmse")] >= rows[("lr", "mae")]
    assert {r.model for r in imp.collect()} == {"rf"}


def test_preview_export(spark, exports):
    rows = study.preview_export(spark, exports["tasks"]["A"], n=5, order_by=["job_id"]).collect()
    assert len(rows) == 5 and all(isinstance(r.job_id, str) for r in rows)
    assert study.preview_export(spark, exports["tasks"]["A"]).count() == 20
