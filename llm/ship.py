"""Make this package importable on executors that were not started with it on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip of the two packages to the application's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(), f"llm-{app}.zip")  # the driver serves it to executors until it ends
    with zipfile.ZipFile(path, "w") as z:
        for package in ("llm", "jobscope"):
            for at, _, names in os.walk(os.path.join(_ROOT, package)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    z.write(full := os.path.join(at, name), os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
