
from jobscope.operators.normalize import normalize_jobs, training_rows, with_intervals
from jobscope.sources.adapters import jobs_from_orders, load
from jobscope.sources.readers import read_clusters, read_csv, read_table
from jobscope.sources.sinks import chart_table, preview, write_result

from conftest import SF_SMALL


def test_csv_round_trip_is_text_then_typed(spark, scratch):
    rows = [("1", "u", "Eval", "COMPLETED", "12.5"), ("2", "v", "Pretrain", "FAILED", "x"),
            ("3", "w", "Eval", "CANCELED", "")]
    spark.createDataFrame(rows, "job_id string, user string, TaskType string, "
                                "TaskStatus string, GPU_Time string") \
        .write.option("header", "true").csv(scratch)
    raw = read_csv(spark, scratch)
    assert all(t == "string" for _, t in raw.dtypes)
    jobs = normalize_jobs(raw, cluster="A")
    got = {r.job_id: (r.cluster, r.task_type, r.state_label, r.gpu_time) for r in jobs.collect()}
    assert got == {"1": ("A", "Eval", "Completed", 12.5), "2": ("A", "Pretrain", "Failed", None),
                   "3": ("A", "Eval", "Canceled", None)}


def test_cluster_registry_union(spark, scratch):
    orders = jobs_from_orders(load(spark, SF_SMALL, "orders"))
    write_result(orders, scratch, partition_by=["cluster"], compact=False)
    paths = {"A": f"{scratch}/cluster=A", "B": f"{scratch}/cluster=B"}
    both = read_clusters(spark, paths)
    counts = {r.cluster: r["count"] for r in both.groupBy("cluster").count().collect()}
    want = {r.cluster: r["count"] for r in orders.groupBy("cluster").count().collect()}
    assert counts == want
    assert read_table(spark, scratch).count() == orders.count()


def test_intervals_and_training_rows(spark):
    df = spark.createDataFrame(
        [("1", "COMPLETED", "2024-01-01 00:00:00", "30", "60", "1", "8", "2"),
         ("2", "COMPLETED", "1704067200", "x", "60", "1", "8", "2"),
         ("3", "FAILED", "2024-01-01 00:00:00", "1", "1", "1", "8", "2")],
        "job_id string, state string, submit_time string, queue string, duration string, "
        "node_num string, cpu_num string, gpu_num string")
    jobs = with_intervals(normalize_jobs(df))
    r = {x.job_id: x for x in jobs.collect()}
    assert r["1"].start_us - r["1"].submit_us == 30_000_000
    assert r["1"].end_us - r["1"].start_us == 60_000_000
    assert r["2"].submit_us == 1704067200 * 1_000_000 and r["2"].start_us is None
    tr = training_rows(normalize_jobs(df))
    assert [x.job_id for x in tr.collect()] == ["1"]     # FAILED and NULL queue dropped
    assert tr.first().label == 60.0


def test_chart_table_and_preview(spark):
    df = spark.createDataFrame([(2, "20-40", 3), (0, "0-20", 5), (1, "20-40", 1)],
                               "bin int, label string, n long")
    ct = chart_table(df, "bin", "label", "n")
    assert ct.columns == ["bin", "label", "value"]
    assert [r.bin for r in preview(ct, ["bin"], 2).collect()] == [0, 1]


def test_csv_corrupt_records_are_kept(spark, scratch):
    import os
    from urllib.parse import urlparse
    local = urlparse(scratch).path          # the shared folder is a file: URI here
    os.makedirs(local, exist_ok=True)
    with open(f"{local}/log.csv", "w") as f:
        f.write("job_id,TaskStatus,GPU_Time\n1,COMPLETED,3.5\n2,FAILED,1,extra\n3,CANCELED,x\n")
    raw = read_csv(spark, scratch, columns=["job_id", "TaskStatus", "GPU_Time"],
                   corrupt_col="_corrupt")
    rows = {r.job_id: r for r in raw.collect()}
    assert rows["2"]._corrupt == "2,FAILED,1,extra"
    assert rows["1"]._corrupt is None
    typed = {r.job_id: r.gpu_time for r in normalize_jobs(raw).collect()}
    assert typed == {"1": 3.5, "2": 1.0, "3": None}


def test_epoch_micros_ignores_session_zone_and_dst(spark):
    import calendar
    import datetime as dt
    from pyspark.sql import types as T
    from jobscope.operators.normalize import epoch_micros_sql
    stamps = [dt.datetime(2024, 1, 15, 3, 4, 5, 123456), dt.datetime(2024, 7, 1, 0, 0, 0, 1),
              dt.datetime(2024, 3, 10, 2, 30, 0), dt.datetime(1969, 12, 31, 23, 59, 59, 999999)]
    df = spark.createDataFrame([(s,) for s in stamps], T.StructType(
        [T.StructField("ts", T.TimestampNTZType())]))
    want = [calendar.timegm(s.timetuple()) * 1_000_000 + s.microsecond for s in stamps]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r.us for r in df.selectExpr(
                f"{epoch_micros_sql('ts', T.TimestampNTZType())} AS us").collect()]
            assert got == want, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
