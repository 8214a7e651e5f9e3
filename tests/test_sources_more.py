"""Wide exports with differing headers, the registry in one scan, quarantined rows, rewritten partitions,
occupancy in steps, histograms of NULL groups."""

import os
import random

import pytest
from pyspark.sql import functions as F

from jobscope.operators.occupancy import gpu_occupancy, occupancy_step
from jobscope.operators.utilization import histogram, unit_means
from jobscope.sources import wide
from jobscope.sources.readers import bad_record_counts, quarantine, read_registry
from jobscope.sources.sinks import write_result


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


# -- S3

def test_cells_are_placed_by_each_files_header(spark, tmp_path):
    put(tmp_path / "u", "a.csv", "Time,g1,g2,g3\n1,10,20,30\n2,20,x,\n")
    put(tmp_path / "u", "b.csv", "g3,Time,g1\n50,3,60\n")
    put(tmp_path / "u", "c.csv", '﻿Time,"g,4",g2\n4,7,8\n')
    put(tmp_path / "u", "d.csv", "Time\n5\n")
    put(tmp_path / "u", "e.csv", "")
    put(tmp_path / "u", "f.csv", "g3,Time,g1\n")
    rows, names = wide.read_wide_long(spark, str(tmp_path / "u"))
    assert names == {"col_1": "g1", "col_2": "g2", "col_3": "g3", "col_4": "g,4"}
    got = {(r.time, r.unit): (r.util, r.position) for r in rows.collect()}
    assert got == {("1", "g1"): (10.0, 1), ("1", "g2"): (20.0, 2), ("1", "g3"): (30.0, 3), ("2", "g1"): (20.0, 1), ("2", "g2"): (None, 2),
                   ("2", "g3"): (None, 3), ("3", "g3"): (50.0, 3), ("3", "g1"): (60.0, 1), ("4", "g,4"): (7.0, 4), ("4", "g2"): (8.0, 2)}
    assert {r.unit: r.mean_util for r in unit_means(rows).collect()} == {"g1": 30.0, "g2": 14.0, "g3": 40.0, "g,4": 7.0}
    table, names = wide.read_wide_reconciled(spark, str(tmp_path / "u"))
    assert table.columns == ["time", "col_1", "col_2", "col_3", "col_4"]
    assert sorted(map(tuple, table.collect())) == [
        ("1", "10", "20", "30", None), ("2", "20", "x", None, None), ("3", "60", None, "50", None), ("4", None, "8", None, "7"), ("5", None, None, None, None)]


@pytest.mark.parametrize("header,match", [("g1,g2", "no 'Time'"), ("Time,g1,g1", "twice")])
def test_headers_that_name_nothing_right(spark, tmp_path, header, match):
    put(tmp_path / "u", "a.csv", f"{header}\n1,2\n")
    with pytest.raises(ValueError, match=match):
        wide.read_wide_long(spark, str(tmp_path / "u"))


def test_files_of_one_header_are_one_scan(spark, tmp_path):
    for i in range(4):
        put(tmp_path / "u", f"{i}.csv", f"Time,a,b\n{i},1,2\n")
    rows, _ = wide.read_wide_long(spark, str(tmp_path / "u"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert rows.count() == 8


# -- S2

def scanned_files(df):
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("Scan csv"):
            found.append(node.selectedPartitions().totalNumberOfFiles())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return found


def test_registry_is_one_scan_and_a_cluster_filter_prunes_files(spark, tmp_path):
    for c, folder in (("A", "one dir"), ("B", "b"), ("C", "b/inner+x")):
        for i in range(3):
            put(tmp_path / folder, f"{i}.csv", f"job_id,state\n{c}{i},COMPLETED\n")
    paths = {"A": f"file://{tmp_path}/one dir", "B": f"{tmp_path}/b/0.csv", "C": f"{tmp_path}/b/inner+x/"}
    df = read_registry(spark, paths)
    assert sorted(map(tuple, df.collect())) == sorted(
        [(f"A{i}", "COMPLETED", "A") for i in range(3)] + [("B0", "COMPLETED", "B")] + [(f"C{i}", "COMPLETED", "C") for i in range(3)])
    assert scanned_files(df) == [7]
    assert scanned_files(read_registry(spark, paths).where("cluster = 'B'")) == [1]
    assert scanned_files(read_registry(spark, paths, columns=["job_id", "state"]).where("cluster IN ('A', 'B')")) == [4]


def test_registry_refuses_patterns_and_nothing(spark):
    with pytest.raises(ValueError):
        read_registry(spark, {})
    with pytest.raises(ValueError, match="pattern"):
        read_registry(spark, {"A": "/x/*.csv"})


# -- S1

@pytest.mark.parametrize("header", [True, False])
def test_every_row_is_either_good_or_quarantined(spark, tmp_path, scratch, header):
    lines = ["1,a,2.5", "2,b", "3,c,4,extra", "4,,x", '5,"q, ""r""",7', "6,d,", ",,1", '7,"e",nan', "8,,1e3"]
    for name in ("x.csv", "y.csv"):
        put(tmp_path / "e", name, "\n".join((["id,name,v"] if header else []) + lines) + "\n")
    good, bad = quarantine(spark, str(tmp_path / "e"), ["id", "name", "v"], scratch, numeric=["id", "v"], header=header)
    assert sorted(map(str, good.collect())) == sorted(2 * [str(r) for r in spark.createDataFrame(
        [("1", "a", "2.5"), ("5", 'q, "r"', "7"), ("6", "d", None), (None, None, "1"), ("7", "e", "nan"), ("8", None, "1e3")], good.schema).collect()])
    assert sorted((r.reason, r.raw) for r in bad.collect()) == sorted(2 * [("fields", "2,b"), ("fields", "3,c,4,extra"), ("number: v", "4,,x")])
    assert sorted((os.path.basename(r.file), r.reason, r.n) for r in bad_record_counts(bad).collect()) == [
        (f, reason, n) for f in ("x.csv", "y.csv") for reason, n in (("fields", 2), ("number: v", 1))]
    assert good.select("id").count() + bad.select("reason").count() == 18  # a narrow query counts the same


def test_quarantine_of_an_empty_export(spark, tmp_path, scratch):
    put(tmp_path / "e", "x.csv", "id,v\n")
    good, bad = quarantine(spark, str(tmp_path / "e"), ["id", "v"], scratch)
    assert good.count() == 0 and bad.count() == 0


# -- S7

def test_rewriting_a_cluster_is_idempotent_and_leaves_the_others(spark, scratch):
    first = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "cluster string, v int")
    write_result(first, scratch)
    for _ in range(2):
        write_result(spark.createDataFrame([("B", 4), ("C", 5)], "cluster string, v int"), scratch, mode="overwrite_partitions")
        assert sorted((r.cluster, r.v) for r in spark.read.parquet(scratch).collect()) == [("A", 1), ("A", 2), ("B", 4), ("C", 5)]
    broken = spark.range(20).selectExpr("'A' AS cluster", "cast(if(id = 17, raise_error('lost'), id) as int) AS v").repartition(4)
    with pytest.raises(Exception, match="lost"):
        write_result(broken, scratch, mode="overwrite_partitions")
    assert sorted((r.cluster, r.v) for r in spark.read.parquet(scratch).collect()) == [("A", 1), ("A", 2), ("B", 4), ("C", 5)]
    with pytest.raises(ValueError, match="partition"):
        write_result(first.select("v"), scratch, mode="overwrite_partitions")


# -- A12

def test_occupancy_in_steps_equals_one_sweep(spark, scratch):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        start = rng.randrange(1000)
        end = rng.choice([None, start, start - 3, start + rng.randrange(1, 600)])
        rows.append((rng.choice(["A", "B", None]), start, end, rng.randrange(1, 9)))
    jobs = spark.createDataFrame(rows, "cluster string, start_us long, end_us long, gpu_num long")
    want = sorted(map(str, gpu_occupancy(jobs).select("cluster", "t", "delta", "gpus_in_use").collect()))
    state, got, last = None, [], -1
    for k, until in enumerate((0, 250, 251, 700, None)):
        high = 10_000 if until is None else until
        out, state = occupancy_step(jobs.where((F.col("start_us") >= last) & (F.col("start_us") < high)), until, state)
        out.write.parquet(f"{scratch}/rows{k}")
        state.write.parquet(f"{scratch}/state{k}")
        got += spark.read.schema(out.schema).parquet(f"{scratch}/rows{k}").select("cluster", "t", "delta", "gpus_in_use").collect()
        state, last = spark.read.schema(state.schema).parquet(f"{scratch}/state{k}"), high
    assert sorted(map(str, got)) == want


def test_a_job_before_the_last_step_is_an_error(spark, scratch):
    jobs = spark.createDataFrame([("A", 5, 50, 2)], "cluster string, start_us long, end_us long, gpu_num long")
    _, state = occupancy_step(jobs, 10)
    state.write.parquet(scratch)
    state = spark.read.parquet(scratch)
    assert sorted((r.kind, r.t, r.delta) for r in state.collect()) == [("carry", 10, 2), ("pending", 50, -2)]
    rows, _ = occupancy_step(jobs.withColumn("start_us", F.lit(20).cast("long")), None, state)
    assert [(r.t, r.gpus_in_use) for r in rows.orderBy("t").collect()] == [(20, 4), (50, 0)]
    with pytest.raises(Exception, match="before the instant"):
        occupancy_step(jobs, None, state)[0].collect()


# -- A9

def test_histogram_keeps_a_null_group(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), (None, 5.0), (None, 9.0), (None, 9.0)], "cluster string, mean_util double")
    got = {(r.cluster, r.bin): (r.bin_lo, r.bin_hi, r.n) for r in histogram(df, bins=2, by=["cluster"]).collect()}
    assert got == {("A", 0): (1.0, 2.0, 1), ("A", 1): (2.0, 3.0, 1), (None, 0): (5.0, 7.0, 1), (None, 1): (7.0, 9.0, 2)}
