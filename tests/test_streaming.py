from jobscope.operators.normalize import normalize_jobs
from jobscope.operators.shares import state_shares
from jobscope.session import scratch_path
from jobscope.sources.adapters import jobs_from_orders, load
from jobscope.streaming.live_shares import job_log_stream, shares_of, start_running_counts

from conftest import SF_SMALL


def test_running_counts_follow_new_files(spark):
    folder = scratch_path(spark, "stream-in")
    jobs = jobs_from_orders(load(spark, SF_SMALL, "orders"))
    first, second = jobs.where("job_id % 3 = 0"), jobs.where("job_id % 3 <> 0")
    first.write.parquet(f"{folder}/part-a")
    stream = job_log_stream(spark, f"{folder}/*", jobs.schema)
    q = start_running_counts(stream, "live_counts_test")
    try:
        q.processAllAvailable()
        snap = spark.table("live_counts_test")
        assert sum(r.n_jobs for r in snap.collect()) == first.count()
        second.write.parquet(f"{folder}/part-b")
        q.processAllAvailable()
        snap = spark.table("live_counts_test")
        got = {(r.cluster, r.state_label): r.n_jobs for r in snap.collect()}
        want = {(r.cluster, r.state): r.n_jobs
                for r in state_shares(normalize_jobs(jobs), by=["cluster"]).collect() if r.n_jobs}
        assert got == want
        shares = shares_of(snap)
        per_cluster = {}
        for r in shares.collect():
            per_cluster[r.cluster] = per_cluster.get(r.cluster, 0) + r.pct_of_all
        assert all(abs(v - 100) < 1e-9 for v in per_cluster.values())
    finally:
        q.stop()


def test_snapshot_sink(spark):
    folder = scratch_path(spark, "stream-snap-in")
    out = scratch_path(spark, "stream-snap-out")
    jobs = jobs_from_orders(load(spark, SF_SMALL, "orders"))
    jobs.write.parquet(f"{folder}/part-a")
    q = start_running_counts(job_log_stream(spark, f"{folder}/*", jobs.schema), "snap_test",
                             sink="snapshot", snapshot_path=out)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(r.n_jobs for r in spark.read.parquet(out).collect()) == jobs.count()


def test_restart_from_checkpoint_does_not_double_count(spark):
    folder = scratch_path(spark, "stream-restart-in")
    ckpt = scratch_path(spark, "stream-restart-ckpt")
    jobs = jobs_from_orders(load(spark, SF_SMALL, "orders"))
    first, second = jobs.where("job_id % 2 = 0"), jobs.where("job_id % 2 = 1")
    first.write.parquet(f"{folder}/part-a")
    q = start_running_counts(job_log_stream(spark, f"{folder}/*", jobs.schema), "restart_a",
                             checkpoint=ckpt)
    q.processAllAvailable()
    q.stop()
    second.write.parquet(f"{folder}/part-b")
    # a new query on the same checkpoint resumes: part-a is not read again
    q = start_running_counts(job_log_stream(spark, f"{folder}/*", jobs.schema), "restart_b",
                             checkpoint=ckpt)
    try:
        q.processAllAvailable()
        total = sum(r.n_jobs for r in spark.table("restart_b").collect())
        assert total == jobs.count()
    finally:
        q.stop()
