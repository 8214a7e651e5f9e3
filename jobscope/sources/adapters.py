"""Adapters from the generic test tables onto job-log and utilisation shapes.

They are plain projections (no shuffle), so every query built on them
scans the whole source table with column pruning and pushdown intact.

jobs_from_orders   ``orders`` -> job log with clusters, types, states, GPU time
jobs_from_events   ``events`` -> job log with queue delay, GPUs, intervals;
                   two raw states outside the known three on purpose
util_from_lineitem ``lineitem`` -> long utilisation samples (unit, time, util)
wide_from_embeddings ``embeddings`` -> wide utilisation table time, col_1..col_n
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.states import lit_sql
from ..operators.normalize import MICROS, epoch_micros_sql

# Fixed values for the adapters.
PRIORITY_TO_TYPE = (("1-URGENT", "Eval"), ("5-LOW", "Pretrain"))
OTHER_TYPE = "Other"
ORDER_STATUS_TO_STATE = (("F", "COMPLETED"), ("O", "CANCELED"), ("P", "FAILED"))
EVENT_TYPE_TO_TYPE = (("click", "Eval"), ("view", "Pretrain"))
EVENT_STATES = ("COMPLETED", "CANCELED", "FAILED", "TIMEOUT", "NODE_FAIL")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col_sql: str, pairs, default: str | None) -> str:
    arms = " ".join(f"WHEN {lit_sql(k)} THEN {lit_sql(v)}" for k, v in pairs)
    other = "NULL" if default is None else lit_sql(default)
    return f"CASE {col_sql} {arms} ELSE {other} END"


def _cluster(key_sql: str) -> str:
    return f"CASE WHEN {key_sql} % 2 = 0 THEN 'A' ELSE 'B' END"


def jobs_from_orders(orders: DataFrame) -> DataFrame:
    """job_id, user, cluster, task_type, state, gpu_time."""
    return orders.selectExpr(
        "o_orderkey AS job_id",
        "o_custkey AS user",
        f"{_cluster('o_orderkey')} AS cluster",
        f"{_case('o_orderpriority', PRIORITY_TO_TYPE, OTHER_TYPE)} AS task_type",
        f"{_case('o_orderstatus', ORDER_STATUS_TO_STATE, None)} AS state",
        "o_totalprice AS gpu_time",
    )


def jobs_from_events(events: DataFrame) -> DataFrame:
    """job_id, user, cluster, task_type, state, queue, gpu_use_count, gpu_num,
    node_num, cpu_num, duration, submit_us, start_us, end_us."""
    states = ", ".join(lit_sql(s) for s in EVENT_STATES)
    submit = epoch_micros_sql("ts", events.schema["ts"].dataType)
    base = events.selectExpr(
        "event_id AS job_id",
        "user_id AS user",
        f"{_cluster('event_id')} AS cluster",
        f"{_case('event_type', EVENT_TYPE_TO_TYPE, OTHER_TYPE)} AS task_type",
        "value AS queue",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        f"{submit} AS submit_us",
    )
    return base.selectExpr(
        "job_id", "user", "cluster", "task_type",
        f"try_element_at(array({states}), CAST(k % {len(EVENT_STATES)} AS INT) + 1) AS state",
        "queue",
        "k AS gpu_use_count",
        "k % 8 + 1 AS gpu_num",
        "k % 4 + 1 AS node_num",
        "(k % 16 + 1) * 8 AS cpu_num",
        "(k + 1) * 60 AS duration",
        "submit_us",
        f"submit_us + CAST(round(queue * {float(MICROS)}D) AS BIGINT) AS start_us",
        f"submit_us + CAST(round(queue * {float(MICROS)}D) AS BIGINT) "
        f"+ (k + 1) * 60 * {MICROS} AS end_us",
    )


def util_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Long utilisation samples: time, unit, util (2 * quantity, so 2..100)."""
    return lineitem.selectExpr(
        "CAST(l_shipdate AS STRING) AS time",
        "l_orderkey AS unit",
        "l_quantity * 2 AS util",
    )


def wide_from_embeddings(embeddings: DataFrame, width: int | None = None) -> DataFrame:
    """Wide utilisation table: ``time`` then ``col_1 .. col_width`` (doubles); the width is that of the longest row."""
    if width is None:
        width = embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    return embeddings.selectExpr(
        "vec_id AS time",
        *[f"CAST(try_element_at(embedding, {i}) AS DOUBLE) AS col_{i}"
          for i in range(1, width + 1)])


def wide_daily_from_events(events: DataFrame) -> DataFrame:
    """Wide utilisation table from events: one row per day, one column per
    event type holding that day's mean value (NULL when the type is absent).
    ``pivot`` finds the column set with one distinct pass, as a wide export
    would have it in its header."""
    day = "to_date(ts)" if "ntz" not in events.schema["ts"].dataType.simpleString() \
        else "CAST(ts AS DATE)"
    return (events.selectExpr(f"{day} AS time", "event_type", "value")
            .groupBy("time").pivot("event_type").agg(F.avg("value")))
