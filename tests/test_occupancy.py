from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobscope.operators.occupancy import gpu_occupancy, gpus_in_use_at, running_sum
from jobscope.plans.inspect import single_partition_windows

SCHEMA = "cluster string, job_id string, submit_us long, start_us long, end_us long, gpu_num double"

# disjoint, nested, same start, end == next start, zero length, spanning
# several buckets, two clusters
INTERVALS = [
    ("A", "j1", 0, 0, 10, 2.0),
    ("A", "j2", 5, 20, 30, 4.0),
    ("A", "j3", 20, 22, 25, 1.0),     # nested in j2
    ("A", "j4", 21, 22, 40, 8.0),     # same start as j3
    ("A", "j5", 25, 30, 35, 3.0),     # starts when j2 ends
    ("A", "j6", 30, 33, 33, 5.0),     # zero length
    ("A", "j7", 1, 1, 1000, 1.0),     # spans everything
    ("B", "k1", 0, 5, 15, 7.0),
    ("B", "k2", 15, 15, 20, 1.0),
]


def brute(rows):
    """Occupancy after each change instant, by direct summation."""
    out = {}
    by_cluster = defaultdict(list)
    for c, _, _, s, e, g in rows:
        by_cluster[c].append((s, e, int(g)))
    for c, iv in by_cluster.items():
        instants = sorted({s for s, _, _ in iv} | {e for _, e, _ in iv})
        for t in instants:
            out[(c, t)] = sum(g for s, e, g in iv if s <= t) - sum(g for s, e, g in iv if e <= t)
    return out


@pytest.mark.parametrize("buckets", [1, 2, 5, 64])
def test_sweep_matches_brute_force(spark, buckets):
    jobs = spark.createDataFrame(INTERVALS, SCHEMA).repartition(3)
    occ = gpu_occupancy(jobs, buckets=buckets)
    got = {(r.cluster, r.t): r.gpus_in_use for r in occ.collect()}
    assert got == brute(INTERVALS)
    assert min(got.values()) >= 0
    last = {}
    for (c, t), v in sorted(got.items()):
        last[c] = v
    assert last == {"A": 0, "B": 0}


def test_probe_at_start_and_submit(spark):
    jobs = spark.createDataFrame(INTERVALS, SCHEMA)
    occ = brute(INTERVALS)
    at_start = {r.job_id: r.gpus_in_use
                for r in gpus_in_use_at(jobs, gpu_occupancy(jobs, buckets=3)).collect()}
    for c, j, sub, s, e, g in INTERVALS:
        assert at_start[j] == occ[(c, s)] - (int(g) if s < e else 0), j
    probed = gpu_occupancy(jobs, probes="submit_us", buckets=3)
    at_submit = {r.job_id: r.gpus_in_use
                 for r in gpus_in_use_at(jobs, probed, at="submit").collect()}
    for c, j, sub, s, e, g in INTERVALS:
        iv = [x for x in INTERVALS if x[0] == c]
        want = sum(x[5] for x in iv if x[3] <= sub) - sum(x[5] for x in iv if x[4] <= sub)
        want -= g if s == sub else 0
        assert at_submit[j] == int(want), j


def test_running_sum_partitioning_invariant(spark):
    df = spark.range(0, 2000).select(F.lit("x").alias("g"), F.col("id").alias("t"),
                                     (F.col("id") % 7 - 3).alias("v"))
    want = {}
    acc = 0
    for t in range(2000):
        acc += t % 7 - 3
        want[t] = acc
    for splits in ([float("-inf"), float("inf")],
                   [float("-inf"), 10.0, 500.5, 1999.0, float("inf")]):
        got = {r.t: r.running for r in
               running_sum(df.repartition(5), "t", "v", splits, by=["g"]).collect()}
        assert got == want


def test_no_single_partition_window(spark):
    jobs = spark.createDataFrame(INTERVALS, SCHEMA)
    assert single_partition_windows(gpu_occupancy(jobs, buckets=4)) == []


def test_running_sum_of_doubles(spark):
    df = spark.createDataFrame([("g", t, v) for t, v in enumerate([0.5, 1.25, -0.75, 2.5])],
                               "g string, t long, v double")
    splits = [float("-inf"), 1.5, float("inf")]
    got = {r.t: r.running for r in running_sum(df, "t", "v", splits, by=["g"]).collect()}
    assert got == {0: 0.5, 1: 1.75, 2: 1.0, 3: 3.5}


def test_hot_instant_and_burst(spark):
    """A third of the jobs start at one instant, another third in a burst."""
    import random
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        if i < 1000:
            s = 500_000                                  # one hot instant
        elif i < 2000:
            s = 1_000_000 + rnd.randrange(0, 2_000)      # a narrow burst
        else:
            s = rnd.randrange(0, 10_000_000)
        rows.append(("A", f"j{i}", s, s, s + rnd.randrange(1, 50_000), float(1 + i % 4)))
    jobs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r.cluster, r.t): r.gpus_in_use for r in gpu_occupancy(jobs, buckets=32).collect()}
    assert got == brute(rows)
    from jobscope.operators.occupancy import quantile_splits
    splits = quantile_splits(jobs, ["start_us", "end_us"], 32)
    in_burst = [x for x in splits if 1_000_000 <= x <= 1_002_000]
    assert len(in_burst) >= 5          # the burst is cut into several buckets


def test_empty_and_invalid_jobs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert gpu_occupancy(empty).count() == 0
    # without an end a job is still running; without a GPU count it holds none
    open_ = spark.createDataFrame([("A", "x", 0, 5, None, 2.0), ("A", "y", 0, 5, 9, None)], SCHEMA)
    assert [(r.t, r.gpus_in_use) for r in gpu_occupancy(open_).collect()] == [(5, 2)]


def test_others_by_interval_comparison(spark):
    """Open, zero-length and reversed intervals and a NULL cluster, against the jobs that overlap."""
    rows = [("A", "background", 0, 0, 100, 12.0), ("A", "running", 10, 40, None, 8.0),
            ("A", "same", 35, 40, 60, 2.0), ("A", "later", 50, 50, 70, 1.0),
            ("A", "zero", 30, 45, 45, 5.0), ("A", "reversed", 44, 46, 41, 9.0),
            ("A", "none", 47, 47, 50, None), (None, "n1", 1, 5, 20, 3.0), (None, "n2", 6, 6, None, 4.0)]
    jobs = spark.createDataFrame(rows, SCHEMA)
    got = {r.job_id: r.gpus_in_use
           for r in gpus_in_use_at(jobs, gpu_occupancy(jobs, buckets=3)).collect()}
    for c, name, _, at, _, _ in rows:
        others = sum(int(g) for c2, n2, _, s, e, g in rows
                     if c2 == c and n2 != name and g is not None and s <= at and (e is None or at < e))
        assert got[name] == others, name


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_fixed_width_buckets(spark, width):
    jobs = spark.createDataFrame(INTERVALS, SCHEMA)
    got = {(r.cluster, r.t): r.gpus_in_use
           for r in gpu_occupancy(jobs, bucket_width=width).collect()}
    assert got == brute(INTERVALS)


@pytest.mark.parametrize("at", ["start", "submit"])
def test_mean_by_occupancy_equals_per_job_path(spark, at):
    from jobscope.functions.binning import BinSpec
    from jobscope.operators.latency import mean_by_bin
    from jobscope.operators.occupancy import mean_by_occupancy
    from jobscope.plans import catalog as C
    from conftest import SF_SMALL
    jobs = C.jobs_e(spark, SF_SMALL)
    occ = gpu_occupancy(jobs, probes="submit_us" if at == "submit" else None)
    spec = BinSpec(0, 80, 10)
    per_job = mean_by_bin(gpus_in_use_at(jobs, occ, at=at), "gpus_in_use", spec,
                          by=["task_type"], unknown_bin=-1, scale=2).collect()
    pre_agg = mean_by_occupancy(jobs, occ, spec, at=at, unknown_bin=-1, scale=2).collect()
    assert sorted(map(tuple, pre_agg)) == sorted(map(tuple, per_job))
