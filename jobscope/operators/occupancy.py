"""GPU occupancy sweep (A12) and the GPUs-in-use probe for each job.

Each job allocates ``g`` GPUs at its start and releases them at its end.
Occupancy after an instant is the sum of all deltas at or before it.

A running sum over the whole log must not become one window over all
rows (an unpartitioned ``Window.orderBy`` puts every row in one task).
``running_sum`` is a two-level prefix sum built from ordinary operators:

1. cut the order axis into buckets whose boundaries are approximate
   quantiles of the instants — one scan of the input, no shuffle — so a
   burst of activity is spread over as many buckets as its size needs;
2. total per (group, bucket) from the netted deltas, and an exclusive
   running sum over those totals — one row per bucket, so this window is
   small;
3. a window per (group, bucket) ordered by the instant, plus the carry.

Deltas at the same instant are netted first (``groupBy(group, bucket, t)``
with map-side partial aggregation), so a hot instant collapses to one row
per task before anything is shuffled, and to one row before any window
sees it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import bin_index_sql
from ..functions.numeric import number_sql
from ..functions.states import q
from .latency import _finish, _prepare


def _parallelism(spark) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # sessions without a local SparkContext (Spark Connect)
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def quantile_splits(df: DataFrame, cols: Sequence[str], buckets: int,
                    rel_error: float | None = None) -> list[float]:
    """Strictly increasing split points (with +-inf ends) from approximate
    quantiles of ``cols``; at most ``buckets - 1`` inner points.

    The default relative error is a quarter of a bucket's share, so buckets
    stay within ~25% of even; it is floored at 1e-4, which holds up to 2,500
    buckets. Beyond that a bucket may be uneven by 1e-4 of the instants.
    """
    if buckets <= 1:
        return [float("-inf"), float("inf")]
    if rel_error is None:
        rel_error = max(1e-4, min(1e-3, 0.25 / buckets))
    probs = [i / buckets for i in range(1, buckets)]
    inner = set()
    for qs in df.approxQuantile(list(cols), probs, rel_error):
        inner.update(float(q) for q in qs)
    return [float("-inf")] + sorted(inner) + [float("inf")]


def _bucket_expr(df: DataFrame, col: str, splits: list[float], out: str) -> DataFrame:
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    src = f"__{out}_src"
    b = Bucketizer(splits=splits, inputCol=src, outputCol=out, handleInvalid="keep")
    staged = df.withColumn(src, F.col(col).cast("double"))
    return b.transform(staged).drop(src).withColumn(out, F.col(out).cast("int"))


def running_sum(df: DataFrame, order: str, value: str, splits: list[float] | None = None,
                by: Sequence[str] = (), out: str = "running",
                bucket_width: float | None = None) -> DataFrame:
    """Inclusive prefix sum of ``value`` ordered by ``order`` within ``by``.

    Rows that share an ``order`` value are netted first, so the output has
    one row per distinct ``(by, order)``: ``*by, order, value, out``.

    * netting is a grouped sum with map-side partial aggregation, so any
      number of rows at one ``order`` value shuffles as one row per task;
    * the per-bucket totals come from the netted rows, whose exchange is
      shared with the prefix sums (``ReusedExchange``), so the input is
      read once; that shuffle carries about one row per bucket and task;
    * the carry window runs over one row per bucket; the prefix-sum window
      runs per ``(by, bucket)``.

    Buckets come from ``splits`` (sorted cut points, e.g. quantiles) or,
    with ``bucket_width``, from ``floor(order / bucket_width)`` — no pass
    over the data to choose them, but a burst inside one bucket stays in
    one task.
    """
    by = list(by)
    if bucket_width is not None:
        rows = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(float(bucket_width))))
    else:
        rows = _bucket_expr(df, order, splits or [float("-inf"), float("inf")], "_bucket")
    net = rows.groupBy(*by, "_bucket", order).agg(F.sum(value).alias(value))
    totals = net.groupBy(*by, "_bucket").agg(F.sum(value).alias("_bt"))
    wb = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, "_bucket",
                          F.coalesce(F.sum("_bt").over(wb), F.lit(0)).alias("_carry"))
    wr = Window.partitionBy(*by, "_bucket").orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = carry.toDF(*[f"_k{i}" for i in range(len(by))], "_kb", "_carry")
    # null-safe: no filter on the buckets is inferred, which would make two exchanges of one
    same = F.col("_bucket").eqNullSafe(F.col("_kb"))
    for i, c in enumerate(by):  # a NULL group is a group like any other
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return (net.join(carry, on=same, how="inner")
            .withColumn(out, F.col("_carry") + F.sum(value).over(wr))
            .select(*by, order, value, out))


def _counted(start: str, end: str, gpus: str):
    """Jobs that hold GPUs: started, and not ended at or before that instant. Without an
    end a job is still running; zero-length and reversed intervals hold nothing."""
    return (F.col(start).isNotNull() & F.col(gpus).isNotNull()
            & (F.col(end).isNull() | (F.col(start) < F.col(end))))


def _deltas(jobs: DataFrame, start: str, end: str, gpus: str, by: Sequence[str], probes: str | None) -> DataFrame:
    """``*by, t, delta``: one pass over the jobs emits both deltas (and the probe instant); a job that
    holds no GPUs still gets a row at its start, with delta 0."""
    g = F.col(gpus).cast("long")
    valid = _counted(start, end, gpus)
    events = [F.struct(F.col(start).alias("t"), F.when(valid, g).otherwise(F.lit(0)).alias("delta")),
              F.struct(F.when(valid, F.col(end)).alias("t"), (-g).alias("delta"))]
    if probes is not None:
        events.append(F.struct(F.col(probes).alias("t"), F.lit(0).cast("long").alias("delta")))
    return jobs.select(*by, F.inline(F.array(*events))).where(F.col("t").isNotNull())


def gpu_occupancy(jobs: DataFrame, start: str = "start_us", end: str = "end_us",
                  gpus: str = "gpu_num", by: Sequence[str] = ("cluster",),
                  probes: str | None = None, buckets: int | None = None,
                  splits: list[float] | None = None,
                  bucket_width: float | None = None) -> DataFrame:
    """GPUs allocated right after every instant where the allocation changes.

    Output: ``*by, t, delta, gpus_in_use`` with one row per distinct
    instant and group. ``probes`` names an extra instant column (e.g. the
    submit time) whose instants get a row too, with delta 0.
    ``buckets`` defaults to four times the default parallelism; their
    boundaries are quantiles of the instants (one eager pass), unless
    ``splits`` or a fixed ``bucket_width`` (in the instant's unit) is given.
    """
    by = list(by)
    deltas = _deltas(jobs, start, end, gpus, by, probes)
    j = jobs.where(F.col(start).isNotNull())
    if splits is None and bucket_width is None:
        n = buckets or 4 * _parallelism(jobs.sparkSession)
        cols = [start, end] + ([probes] if probes else [])
        splits = quantile_splits(j.select(*[F.col(c).cast("double") for c in cols]), cols, n)
    return running_sum(deltas, "t", "delta", splits,
                       by=by, out="gpus_in_use", bucket_width=bucket_width)


def occupancy_step(jobs: DataFrame, until: int | None, state: DataFrame | None = None,
                   start: str = "start_us", end: str = "end_us", gpus: str = "gpu_num",
                   by: Sequence[str] = ("cluster",), buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The occupancy sweep continued: the rows before ``until``, and what a later step needs.

    ``jobs`` are those not given to an earlier step; they start at or after
    its ``until``. ``state`` is what that step returned (None at first):
    ``*by, kind, t, delta`` with one ``carry`` row per group, the GPUs in
    use at ``until``, and the ``pending`` rows, the netted releases that lie
    at or after it. Its size is that of the jobs still running, so a day's
    step reads the day's jobs and this table, never the old log. The steps'
    rows together are those of one sweep over all jobs. ``until=None`` ends
    the log. A job that starts before the last ``until`` is an error.

    Store both results (they are used lazily) before the next step reads
    the state.
    """
    by = list(by)
    deltas = _deltas(jobs, start, end, gpus, by, None)
    carry = None
    if state is not None:
        carry = state.where("kind = 'carry'").select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(by)], F.col("delta").alias("_carry"))
        since = state.where("kind = 'carry'").agg(F.max("t")).first()[0]
        if since is not None:
            late = F.expr(f"if(t < {int(since)}, raise_error('a job starts before the instant the last step ended at'), t)").cast("long")
            deltas = deltas.withColumn("t", late)
        deltas = deltas.unionByName(state.where("kind = 'pending'").select(*by, "t", "delta"))
    now = deltas if until is None else deltas.where(F.col("t") < until)
    n = buckets or 4 * _parallelism(jobs.sparkSession)
    rows = running_sum(now, "t", "delta", quantile_splits(now.select(F.col("t").cast("double")), ["t"], n), by=by, out="gpus_in_use")
    sums = now.groupBy(*by).agg(F.sum("delta").alias("delta"))
    if carry is not None:  # one row per group
        same = F.lit(True)
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_c{i}"))
        rows = rows.join(carry, same, "left").withColumn("gpus_in_use", F.col("gpus_in_use") + F.coalesce("_carry", F.lit(0))) \
            .select(*by, "t", "delta", "gpus_in_use")
        sums = sums.unionByName(carry.toDF(*by, "delta")).groupBy(*by).agg(F.sum("delta").alias("delta"))
    carries = sums.select(*by, F.lit("carry").alias("kind"), F.lit(until).cast("long").alias("t"), "delta")
    if until is None:
        return rows, carries
    pending = deltas.where(F.col("t") >= until).groupBy(*by, "t").agg(F.sum("delta").alias("delta"))
    return rows, carries.unionByName(pending.select(*by, F.lit("pending").alias("kind"), "t", "delta"))


def gpus_in_use_at(jobs: DataFrame, occupancy: DataFrame, at: str = "start",
                   start: str = "start_us", submit: str = "submit_us",
                   gpus: str = "gpu_num", by: Sequence[str] = ("cluster",),
                   out: str = "gpus_in_use", end: str = "end_us") -> DataFrame:
    """Attach to each job the GPUs in use by *other* jobs when it starts
    (``at='start'``) or when it is submitted (``at='submit'``).

    An equi-join on (group, instant); a hot instant is a skewed key that
    AQE's skew-join handling splits on the job side. The job's own GPUs
    are subtracted when they are already allocated at that instant.
    """
    by = list(by)
    col = start if at == "start" else submit
    occ = occupancy.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
                           F.col("t").alias("_kt"), F.col("gpus_in_use").alias("_occ"))
    same = F.col(col) == F.col("_kt")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = jobs.join(occ, on=same, how="left")
    mine = _own(at, start, end, submit, gpus)
    return joined.withColumn(out, F.col("_occ") - mine).select(*jobs.columns, out)


def _own(at: str, start: str, end: str, submit: str, gpus: str):
    """The job's own GPUs, if it holds them at the probed instant."""
    held = _counted(start, end, gpus)
    if at != "start":
        held = held & (F.col(start) == F.col(submit))
    return F.when(held, F.col(gpus).cast("long")).otherwise(F.lit(0).cast("long"))


def mean_by_occupancy(jobs: DataFrame, occupancy: DataFrame, spec, value: str = "queue",
                      by: Sequence[str] = ("task_type",), at: str = "start",
                      start: str = "start_us", submit: str = "submit_us",
                      gpus: str = "gpu_num", group: Sequence[str] = ("cluster",),
                      task_types: Sequence[str] | None = None, scale: int | None = None,
                      unknown_bin: int | None = None, sort: bool = True,
                      end: str = "end_us") -> DataFrame:
    """Mean of ``value`` per bin of GPUs in use by other jobs (A12 with A4, A13).

    Gives the same numbers as ``mean_by_bin`` over ``gpus_in_use_at``, but
    jobs are first aggregated per (group, instant, own GPUs, *by) — sums
    (exact decimals with ``scale``) and counts, map-side partial aggregation — so the join to
    the occupancy table carries one row per distinct instant and job shape
    instead of one per job. A third of all jobs starting together is one row
    per shape, not a hot join key. Output: ``*by, bin, n_jobs, mean_<value>, label``.
    """
    by, group = list(by), list(group)
    key = start if at == "start" else submit
    own = _own(at, start, end, submit, gpus)
    pre = (_prepare(jobs, task_types, None)
           .groupBy(*group, key, own.alias("_own"), *by)
           .agg(F.count(F.lit(1)).alias("_n"),
                F.expr(f"sum({number_sql(q(value), scale)})").alias("_s"),
                F.count(value).alias("_c")))
    occ = occupancy.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)],
                           F.col("t").alias("_kt"), F.col("gpus_in_use").alias("_occ"))
    same = F.col(key) == F.col("_kt")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    probed = pre.join(occ, on=same, how="left") \
        .withColumn("_in_use", F.col("_occ") - F.col("_own"))
    agg = probed.groupBy(*by, F.expr(bin_index_sql("_in_use", spec)).alias("bin")).agg(
        F.sum("_n").alias("n_jobs"),
        F.try_divide(F.sum("_s").cast("double"), F.sum("_c").cast("double"))
        .alias(f"mean_{value}"))
    return _finish(agg, spec, by, "bin", "label", sort, "cluster", unknown_bin)
