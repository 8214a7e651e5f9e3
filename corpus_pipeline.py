"""From raw documents to packed training sequences, stage by stage.

``STAGES`` holds (name, function) pairs; each function takes
``(spark, docs, sf_dir)`` and works on all rows that the stage before it
kept. ``run`` writes each stage's result as Parquet in the shared folder
and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobscope.session import scratch_path
from llm import stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("near_dedup", stages.drop_near_duplicates),
    ("packing", stages.pack_sequences),
]

#: No stage but the line dedup has an SQL form; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
