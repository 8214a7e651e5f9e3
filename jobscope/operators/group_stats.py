"""Group statistics as a pipeline stage of its own.

``GroupStatistics`` learns, for each of its columns, how many training rows
a value has and the sum of their labels; the fitted model adds
``<column>_rows`` and ``<column>_mean`` to any frame by joining these
tables. Save a pipeline that holds the model and the tables are stored
inside it as Parquet, so a loaded pipeline scores rows without the
training frame.

Rows in which ``ownCol`` is true are training rows: their own label is
taken out of their statistics. A frame without that column has none, so
scoring needs no special call.

Scale: fitting is one grouped aggregate per column, written to the shared
folder (``spark.checkpoint.dir``), so neither the fitting nor later scoring
reads the training frame again for it. A column may have any number of
values; AQE broadcasts its table or splits a hot value by measured size.
Only the overall mean label reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
                             DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

OWN_COL = "_own"


class _GroupParams(HasInputCols, HasLabelCol):
    ownCol: Param[str] = Param(Params._dummy(), "ownCol", "boolean column that marks training rows",
                               typeConverter=TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(ownCol=OWN_COL, labelCol="label")


class GroupStatistics(_GroupParams, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Number of training rows and mean label of each value of ``inputCols`` (NULL is a value like any other)."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), labelCol: str = "label", ownCol: str = OWN_COL):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> GroupStatisticsModel:
        spark, label = dataset.sparkSession, self.getLabelCol()
        tables = []
        for c in self.getInputCols():
            table = dataset.groupBy(F.col(c).alias("value")).agg(
                F.count(label).alias("rows"), F.sum(F.col(label).cast("double")).alias("total"))
            path = scratch_path(spark, "group-statistics")
            table.write.parquet(path)
            tables.append(spark.read.schema(table.schema).parquet(path))
        model = GroupStatisticsModel(tables)
        # a value's sums add up to the mean of all rows: no second pass over them
        n, total = tables[0].agg(F.sum("rows"), F.sum("total")).first() if tables else (0, 0.0)
        return self._copyValues(model)._set(overall=float(total) / n if n else 0.0)


class GroupStatisticsModel(_GroupParams, Model, MLReadable, MLWritable):
    """Adds ``<column>_rows`` and ``<column>_mean``; a value without training rows gets 0 and the mean of all."""

    overall: Param[float] = Param(Params._dummy(), "overall", "mean label of all training rows",
                                  typeConverter=TypeConverters.toFloat)

    def __init__(self, tables: Sequence[DataFrame] = ()):
        super().__init__()
        self.tables = list(tables)  #: one ``(value, rows, total)`` per input column

    def _transform(self, dataset: DataFrame) -> DataFrame:
        label, own_col = self.getLabelCol(), self.getOrDefault("ownCol")
        overall = F.lit(self.getOrDefault("overall"))
        own, mine = F.lit(0), F.lit(0.0)
        if own_col in dataset.columns:
            held = F.coalesce(F.col(own_col), F.lit(False)) & F.col(label).isNotNull()
            own, mine = held.cast("long"), F.when(held, F.col(label).cast("double")).otherwise(0.0)
        out = dataset
        for c, table in zip(self.getInputCols(), self.tables):
            named = table.toDF("_value", "_rows", "_total")
            rows = F.coalesce(F.col("_rows"), F.lit(0)) - own
            out = (out.join(named, F.col(c).eqNullSafe(F.col("_value")), "left")
                   .withColumns({f"{c}_rows": rows.cast("double"),
                                 f"{c}_mean": F.when(rows > 0, (F.col("_total") - mine) / rows).otherwise(overall)})
                   .drop("_value", "_rows", "_total"))
        return out

    def copy(self, extra=None):
        that = super().copy(extra)
        that.tables = self.tables
        return that

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: GroupStatisticsModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for i, table in enumerate(self.model.tables):
            table.write.parquet(f"{path}/tables/{i}")


class _Reader(MLReader):
    def load(self, path: str) -> GroupStatisticsModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = GroupStatisticsModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.tables = [self.sparkSession.read.parquet(f"{path}/tables/{i}") for i in range(len(model.getInputCols()))]
        return model
