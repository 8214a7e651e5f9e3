import pytest

from jobscope.functions.binning import BinSpec
from jobscope.operators.latency import (QUEUE_BINS, cancels_by_queue_bin, count_by_bin,
                                        mean_by_bin)
from jobscope.operators.normalize import normalize_jobs

SCHEMA = "cluster string, TaskType string, TaskStatus string, queue string, GpuUseCount string"
ROWS = [
    ("A", "Eval", "CANCELED", "5", "0"),
    ("A", "Eval", "CANCELED", "250", "150"),
    ("A", "Eval", "COMPLETED", "110", "1949"),
    ("A", "Eval", "CANCELED", "301", "1950"),
    ("A", "Eval", "CANCELED", None, "2000"),
    ("A", "Eval", "CANCELED", "-3", "x"),
    ("A", "Pretrain", "CANCELED", "45.5", "10"),
    ("B", "Eval", "FAILED", "20", "99"),
]


@pytest.fixture(scope="module")
def jobs(spark):
    return normalize_jobs(spark.createDataFrame(ROWS, SCHEMA))


def test_cancel_bins_ordered_by_index(jobs):
    out = cancels_by_queue_bin(jobs).collect()
    # ordered by integer bin, Unknown (NULL bin) last; 250 -> 240-260, not "200-220"
    assert [(r.bin, r.label, r.n_jobs) for r in out] == [
        (0, "0-20", 1), (12, "240-260", 1), (15, ">300", 1), (None, "Unknown", 2)]


def test_label_order_is_numeric(jobs):
    labels = [r.label for r in count_by_bin(jobs, "queue", QUEUE_BINS).collect()]
    assert labels[:3] == ["0-20", "20-40", "40-60"]


def test_mean_by_bin_study_layout(jobs):
    spec = BinSpec(0, 1950, 150)
    out = {r.bin: (r.label, r.n_jobs, r.mean_queue)
           for r in mean_by_bin(jobs, "gpu_use_count", spec, task_types=["Eval"]).collect()}
    assert out[0] == ("0-150", 2, 12.5)            # cluster A (0) and cluster B (99)
    assert out[1] == ("150-300", 1, 250.0)
    assert out[12] == ("1800-1950", 2, 205.5)     # 1949 and the closed last edge 1950
    assert out[None][0] == "Unknown" and out[None][1] == 2   # 2000 and 'x'


def test_per_cluster_layouts(jobs):
    specs = {"A": BinSpec(0, 2000, 1000), "B": BinSpec(0, 100, 50)}
    out = {(r.cluster, r.bin): r.label
           for r in mean_by_bin(jobs, "gpu_use_count", specs, by=["cluster"]).collect()}
    assert out[("A", 0)] == "0-1000" and out[("A", 1)] == "1000-2000"
    assert out[("B", 1)] == "50-100"
    with pytest.raises(ValueError):
        mean_by_bin(jobs, "gpu_use_count", specs)


def test_small_values_are_not_rounded(spark):
    df = spark.createDataFrame([(1.0, 0.004)] * 3 + [(1.0, None)], "x double, queue double")
    for scale in (None, 3):
        assert mean_by_bin(df, "x", BinSpec(0, 10, 10), scale=scale).first().mean_queue == pytest.approx(0.004)


def test_bigints_keep_their_digits(spark):
    from jobscope.functions.numeric import to_long_sql
    df = spark.createDataFrame([("9007199254740993",), ("12.7",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.selectExpr(to_long_sql("v")).collect()] == [9007199254740993, 12, None, None]
