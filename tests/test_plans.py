"""Plan checks over the registered reports (no job is run for most)."""

import pytest

import __spark_entry__ as E
from jobscope.plans.catalog import QUERIES
from jobscope.plans.inspect import (python_udf_nodes, scan_read_schemas,
                                    single_partition_windows)

from conftest import SF_SMALL

CHEAP = [n for n in QUERIES if n not in
         ("q01_csv_ingest", "q20_minmax_features", "q21_string_index", "q23_linear_one_feature",
          "q24_model_metrics", "q25_feature_importance")]


@pytest.mark.parametrize("name", CHEAP)
def test_no_python_udf_and_no_global_window(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert python_udf_nodes(df) == []
    assert single_partition_windows(df) == []


def test_share_scan_reads_only_needed_columns(spark):
    df = E.queries()["q02_state_share"](spark, SF_SMALL)
    assert scan_read_schemas(df) == ["struct<o_orderstatus:string>"]


def test_cluster_share_scan(spark):
    df = E.queries()["q03_state_share_by_cluster"](spark, SF_SMALL)
    assert scan_read_schemas(df) == ["struct<o_orderkey:bigint,o_orderstatus:string>"]


def test_contract_keys(spark):
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(QUERIES) <= set(qs)
    assert set(QUERIES) - set(sql) == {"q24_model_metrics", "q25_feature_importance"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 8
    assert df.columns == ["cluster", "state", "state_order", "n_jobs", "pct_of_all", "pct_of_known"]


def test_filters_reach_the_scan_on_a_stored_log(spark, scratch):
    from jobscope.operators.latency import QUEUE_BINS, count_by_bin
    from jobscope.operators.normalize import normalize_jobs
    from jobscope.plans.inspect import pushed_filters
    from jobscope.sources.adapters import jobs_from_events, load
    from jobscope.sources.sinks import write_result
    write_result(jobs_from_events(load(spark, SF_SMALL, "events")), scratch, compact=False)
    jobs = normalize_jobs(spark.read.parquet(scratch))
    df = count_by_bin(jobs, "queue", QUEUE_BINS, task_types=["Eval"],
                      where="state = 'CANCELED'", sort=False)
    pushed = " ".join(pushed_filters(df))
    assert "task_type" in pushed and "state" in pushed
    # cluster is the partition column of the stored log: pruned, not scanned
    from jobscope.plans.inspect import formatted
    import re
    plan = formatted(jobs.where("cluster = 'A'"))
    parts = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert parts and "cluster" in parts[0] and "= A" in parts[0]


def test_window_check_detects_a_global_window(spark):
    from pyspark.sql import Window, functions as F
    from jobscope.plans.inspect import single_partition_windows
    df = spark.range(10).withColumn("r", F.sum("id").over(Window.orderBy("id")))
    assert single_partition_windows(df) != []
    keyed = spark.range(10).withColumn("r", F.sum("id").over(Window.partitionBy(F.col("id") % 2)
                                                             .orderBy("id")))
    assert single_partition_windows(keyed) == []


def test_udf_check_detects_a_python_udf(spark):
    from pyspark.sql import functions as F
    from jobscope.plans.inspect import python_udf_nodes
    plus = F.udf(lambda x: x + 1, "long")
    assert python_udf_nodes(spark.range(3).select(plus("id"))) != []


@pytest.mark.parametrize("name,scans", [("q16_gpu_occupancy", 1), ("q17_queue_by_occupancy", 2), ("q17b_queue_by_occupancy_at_submit", 2)])
def test_occupancy_shares_the_netted_exchange(spark, name, scans):
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == scans and plan.count("ReusedExchange") == 1
