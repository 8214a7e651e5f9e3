"""Stages of the corpus pipeline: each takes ``(spark, docs, sf_dir)`` and returns a DataFrame.

All but the last return the columns of ``docs``. Rows with a null id pass
through filters on their text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import line_dedup, lsh_forest, nnls_pack, toxicity
from llm.common import fresh, materialise, read_table
from llm.queries import END_ID, tokenizer_source
from llm.ship import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from all labels of ``sf_dir``."""
    ship(spark)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where("label is not null")
    score = fresh(docs, "_score")
    scored = docs.withColumn(score, toxicity.score_column(docs, toxicity.fit(docs, labels)))
    return scored.where(F.col(score) < 0.5).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of windows that an earlier document or line has; n_chars follows."""
    out = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (5 words, 0.8): that with the smallest id, and one row of it."""
    ship(spark)
    found = lsh_forest.near_duplicates(docs, threshold=0.8, width=5)
    dropped = materialise(found.where("not kept").select("doc_id").distinct(), "dropped")
    small = dropped.count() <= lsh_forest.BROADCAST_IDS
    kept = docs.join(F.broadcast(dropped) if small else dropped, "doc_id", "left_anti").select(docs.columns)
    twice = kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).union(once)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 2048 tokens."""
    ship(spark)
    return nnls_pack.pack(docs, tokenizer_source(), END_ID)
