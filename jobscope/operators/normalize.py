"""Normalisation of a raw job log.

``normalize_jobs`` is a single projection: rename aliases, try_cast every
numeric column, relabel the state. It adds no shuffle and Catalyst pushes
later filters through it to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import to_double, to_double_sql, to_long_sql
from ..functions.states import lit_sql, q, state_label_sql
from ..sources.schemas import JOB_ALIASES, JOB_COLUMNS

MICROS = 1_000_000


def epoch_micros_sql(col_sql: str, dtype: T.DataType) -> str:
    """Epoch microseconds of a timestamp column, as SQL text.

    A zone-less timestamp (TIMESTAMP_NTZ) is read as UTC wall time whatever
    the session time zone is. It is built from zone-free parts (days since
    1970, hour, minute, seconds with fraction) in exact integer arithmetic:
    going through a zoned timestamp would bring in the session zone, and a
    wall time inside its daylight-saving gap would come out an hour off.
    A zoned timestamp is an instant already.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return (f"(CAST(datediff(CAST({col_sql} AS DATE), DATE '1970-01-01') AS BIGINT) "
                f"* 86400000000 + CAST(hour({col_sql}) AS BIGINT) * 3600000000 "
                f"+ CAST(minute({col_sql}) AS BIGINT) * 60000000 "
                f"+ CAST(date_part('SECOND', {col_sql}) * 1000000 AS BIGINT))")
    return f"unix_micros({col_sql})"


def canonical_names(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rename header aliases to canonical names (first alias present wins)."""
    aliases = JOB_ALIASES if aliases is None else aliases
    taken = set(df.columns)
    renames = {}
    for src, dst in aliases.items():
        if src in taken and dst not in taken and dst not in renames.values():
            renames[src] = dst
    return df.withColumnsRenamed(renames) if renames else df


def _to_timestamp_sql(c: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.TimestampType):
        return c
    if isinstance(dtype, T.TimestampNTZType):
        return f"timestamp_micros({epoch_micros_sql(c, dtype)})"
    if isinstance(dtype, (T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.DecimalType)):
        return f"timestamp_seconds({c})"
    # text: a number of epoch seconds, or a date-time string
    return (f"CASE WHEN try_cast({c} AS double) IS NOT NULL "
            f"THEN timestamp_seconds(try_cast({c} AS double)) ELSE try_to_timestamp({c}) END")


def normalize_jobs(df: DataFrame, cluster: str | None = None,
                   aliases: dict[str, str] | None = None) -> DataFrame:
    """Canonical job log: typed columns plus ``state_label``.

    Columns that are absent stay absent; a ``cluster`` literal is added when
    the input has none and ``cluster`` is given.
    """
    df = canonical_names(df, aliases)
    fields = {f.name: f.dataType for f in df.schema.fields}
    exprs = []
    for name, have in fields.items():
        want = JOB_COLUMNS.get(name)
        c = q(name)
        if want is None:
            exprs.append(c)
        elif isinstance(want, T.DoubleType):
            exprs.append(f"{to_double_sql(c)} AS {c}")
        elif isinstance(want, T.LongType):
            exprs.append(f"{to_long_sql(c)} AS {c}")
        elif isinstance(want, T.TimestampType):
            exprs.append(f"{_to_timestamp_sql(c, have)} AS {c}")
        else:
            exprs.append(f"CAST({c} AS STRING) AS {c}")
    if cluster is not None and "cluster" not in fields:
        exprs.append(f"{lit_sql(cluster)} AS cluster")
    if "state" in fields:
        exprs.append(f"{state_label_sql(q('state'))} AS state_label")
    return df.selectExpr(*exprs)


def with_intervals(df: DataFrame) -> DataFrame:
    """Add ``submit_us``, ``start_us``, ``end_us`` (epoch microseconds, long).

    ``start`` is taken from ``start_time`` when present, else submit + queue;
    ``end`` from ``end_time``, else start + duration. Whole-microsecond
    rounding keeps the arithmetic exact in long.
    """
    cols = set(df.columns)
    if "submit_time" not in cols and "start_time" not in cols:
        raise ValueError("intervals need submit_time (with queue) or start_time")
    out = {}
    submit = F.unix_micros(F.col("submit_time")) if "submit_time" in cols else None
    if submit is not None:
        out["submit_us"] = submit
    queue_us = F.round(F.col("queue") * F.lit(MICROS)).cast("bigint")
    dur_us = F.round(F.col("duration") * F.lit(MICROS)).cast("bigint")
    if "start_time" in cols:
        start = F.coalesce(F.unix_micros(F.col("start_time")),
                           submit + queue_us if submit is not None else F.lit(None))
    else:
        start = submit + queue_us
    out["start_us"] = start
    df = df.withColumns(out)
    if "end_time" in cols:
        end = F.coalesce(F.unix_micros(F.col("end_time")), F.col("start_us") + dur_us)
    else:
        end = F.col("start_us") + dur_us
    return df.withColumn("end_us", end)


def training_rows(jobs: DataFrame, label: str = "duration",
                  required=("node_num", "gpu_num", "cpu_num", "queue", "duration"),
                  state: str = "COMPLETED") -> DataFrame:
    """Rows a duration model may learn from.

    Keeps finished jobs of the given raw state, drops rows with a NULL in any
    required numeric column, and copies the target into ``label``.
    """
    out = jobs.where(F.col("state") == state)
    for c in required:
        out = out.withColumn(c, to_double(c))
    return out.dropna(subset=list(required)).withColumn("label", F.col(label).cast("double"))
