import pytest

from jobscope.operators.normalize import normalize_jobs
from jobscope.operators.shares import state_shares, unsuccessful_breakdown

SCHEMA = "cluster string, TaskStatus string, GPU_Time string"


def jobs(spark, rows):
    return normalize_jobs(spark.createDataFrame(rows, SCHEMA))


def as_map(df, key="state"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_relabel_before_group(spark):
    # two unknown raw states must add up in one Unknown group (defect D4)
    rows = [("A", "COMPLETED", "10"), ("A", "CANCELED", "5"), ("A", "FAILED", "1"),
            ("A", "TIMEOUT", "2"), ("A", "NODE_FAIL", "2"), ("A", None, "0")]
    out = as_map(state_shares(jobs(spark, rows)))
    assert set(out) == {"Completed", "Canceled", "Failed", "Unknown"}
    assert out["Unknown"]["n_jobs"] == 3
    assert sum(r["pct_of_all"] for r in out.values()) == pytest.approx(100.0)
    assert out["Completed"]["pct_of_all"] == pytest.approx(100 / 6)
    assert out["Completed"]["pct_of_known"] == pytest.approx(100 / 3)
    assert out["Unknown"]["pct_of_known"] is None
    known = sum(r["pct_of_known"] for r in out.values() if r["pct_of_known"] is not None)
    assert known == pytest.approx(100.0)


def test_weighted_and_zero_total(spark):
    rows = [("A", "COMPLETED", "0"), ("A", "CANCELED", "0")]
    out = as_map(state_shares(jobs(spark, rows), weight="gpu_time"))
    assert all(r["pct_of_all"] == 0.0 for r in out.values())
    assert out["Failed"]["n_jobs"] == 0 and out["Failed"]["gpu_time"] == 0.0


def test_missing_state_is_zero_per_group(spark):
    rows = [("A", "COMPLETED", "1.5"), ("B", "FAILED", "2.25"), ("B", "FAILED", "x")]
    out = state_shares(jobs(spark, rows), by=["cluster"], weight="gpu_time").collect()
    got = {(r.cluster, r.state): r for r in out}
    assert len(got) == 8
    assert got[("A", "Failed")].n_jobs == 0
    assert got[("B", "Failed")].n_jobs == 2
    assert got[("B", "Failed")].gpu_time == 2.25      # malformed 'x' -> NULL, ignored
    assert got[("B", "Failed")].pct_of_all == 100.0
    assert got[("A", "Completed")].pct_of_known == 100.0


def test_empty_input(spark):
    out = state_shares(jobs(spark, []))
    # global aggregate over no rows still yields one group of zeros
    assert {r.state: r.n_jobs for r in out.collect()} == {
        "Completed": 0, "Canceled": 0, "Failed": 0, "Unknown": 0}


def test_unsuccessful_breakdown(spark):
    rows = [("A", "COMPLETED", "10"), ("A", "CANCELED", "6"), ("A", "FAILED", "2"),
            ("A", "TIMEOUT", "2")]
    r = unsuccessful_breakdown(jobs(spark, rows), by=["cluster"]).first()
    assert (r.n_jobs, r.n_unsuccessful, r.n_canceled) == (4, 3, 1)
    assert r.pct_canceled_of_unsuccessful == pytest.approx(100 / 3)
    assert r.pct_gpu_time_canceled_of_unsuccessful == pytest.approx(60.0)


def test_weights_are_summed_as_they_are(spark):
    rows = [("A", "COMPLETED", "0.004"), ("A", "COMPLETED", "0.004"), ("A", "CANCELED", "1e17")]
    out = {r.state: r.gpu_time for r in state_shares(jobs(spark, rows), weight="gpu_time").collect()}
    assert out["Completed"] == pytest.approx(0.008) and out["Canceled"] == 1e17
    exact = {r.state: r.gpu_time for r in state_shares(jobs(spark, rows), weight="gpu_time", scale=3).collect()}
    assert exact["Completed"] == 0.008 and exact["Canceled"] == 1e17


def test_status_alias(spark):
    df = spark.createDataFrame([("CANCELED", "Eval")], "Status string, TaskType string")
    n = normalize_jobs(df)
    assert set(n.columns) >= {"state", "task_type", "state_label"}
    assert n.first().state_label == "Canceled"
