"""Global ranks without a global window, and samples of an exact size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.states import q
from ..session import scratch_path


def global_rank(df: DataFrame, order: Sequence[str], out: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 1) in the order of the columns ``order``.

    Rows are range-partitioned by the order and numbered within each range;
    the ranges' sizes, one number per partition, go to the driver and come
    back as offsets. Rows alike in all of ``order`` get different places in
    one range, so their order should name a key. The ranged rows are stored
    in the shared folder: the ranges are chosen once.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "ranked")
    cut = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    cut.write.parquet(path)
    ranged = spark.read.schema(cut.schema).parquet(path)
    sizes = dict(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, seen = [], 0
    for part in sorted(sizes):
        offsets.append((part, seen))
        seen += sizes[part]
    before = spark.createDataFrame(offsets, "_range int, _before long")  # a row per partition
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_at", at).join(F.broadcast(before), "_range") \
        .withColumn(out, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def salted_md5_sql(key: str, seed: int) -> str:
    return f"md5(concat('{seed}:', CAST({q(key)} AS string)))"


def exact_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """Exactly ``k`` rows (all, if fewer) without replacement: those with the lowest salted hash of ``key``.

    One scan: every task keeps a heap of its k lowest rows, and the heaps
    are merged (Spark plans ``TakeOrderedAndProject``; beyond its sort
    fallback threshold it range-sorts instead). The outcome does not depend
    on partitioning, and a sample of a union is the sample of the samples'
    union (``merge_samples``). Rows with equal keys come in the order of a
    hash of all columns; a NULL key hashes last.
    """
    if k < 0:
        raise ValueError("a sample has at least 0 rows")
    tie = "xxhash64(" + ", ".join(q(c) for c in df.columns) + ")"
    return df.orderBy(F.expr(salted_md5_sql(key, seed)).asc_nulls_last(), F.col(key), F.expr(tie)).limit(k)


def merge_samples(samples: Sequence[DataFrame], key: str, k: int, seed: int = 42) -> DataFrame:
    """The sample of several tables from their samples of at least ``k`` rows, e.g. one a day."""
    both = samples[0]
    for s in samples[1:]:
        both = both.unionByName(s)
    return exact_sample(both, key, k, seed)
