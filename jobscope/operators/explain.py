"""What a duration model looks at (M4-M6, M13): slots of feature vectors,
loadings of the PCA axes, importances of raw columns, permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.states import lit_sql, q
from .ranking import global_rank, salted_md5_sql


# ------------------------------------------------------------------- slots

def slot_names(df: DataFrame, vector_col: str) -> list[str]:
    """Names of a vector column's slots from its ML attribute metadata; ``<column>_<i>`` where it has none."""
    attr = df.schema[vector_col].metadata.get("ml_attr", {})
    named = {a["idx"]: a["name"] for group in attr.get("attrs", {}).values() for a in group if "name" in a}
    width = attr.get("num_attrs", max(named, default=-1) + 1)
    return [named.get(i, f"{vector_col}_{i}") for i in range(max(width, max(named, default=-1) + 1))]


def feature_slots(df: DataFrame, vector_col: str = "features", key: Sequence[str] = ("job_id",),
                  names: Sequence[str] | None = None) -> DataFrame:
    """``(*key, slot, name, value)``: the non-zero slots of each row's feature vector (M4, M5).

    A vector's width is bounded by the closed vocabularies and numeric
    columns it was assembled from. Names default to the column's metadata.
    """
    labels = list(names) if names is not None else slot_names(df, vector_col)
    lookup = f"try_element_at(array({', '.join(map(lit_sql, labels))}), slot + 1)" if labels else "CAST(NULL AS string)"
    cells = df.select(*key, vector_to_array(F.col(vector_col)).alias("_cells"))
    return (cells.selectExpr(*[q(c) for c in key], "posexplode(_cells) AS (slot, value)").where("value <> 0")
            .selectExpr(*[q(c) for c in key], "slot", f"coalesce({lookup}, concat('slot_', slot)) AS name", "value"))


# ---------------------------------------------------------------- loadings

def _pca_of(fitted: PipelineModel):
    found = [s for s in fitted.stages if hasattr(s, "pc") and hasattr(s, "explainedVariance")]
    if not found:
        raise ValueError("the pipeline has no PCA stage")
    return found[0]


def loadings(fitted: PipelineModel) -> list[list[float]]:
    """Per PCA axis its unit vector over the feature slots (M6). An axis is defined up to its sign: here
    the entry of the greatest size is positive (the first of equal ones)."""
    out = []
    for axis in _pca_of(fitted).pc.toArray().T:
        top = max(range(len(axis)), key=lambda i: (round(abs(float(axis[i])), 9), -i))
        sign = -1.0 if axis[top] < 0 else 1.0
        out.append([sign * float(x) for x in axis])
    return out


def pca_loadings(fitted: PipelineModel, names: Sequence[str], digits: int = 6) -> DataFrame:
    """Rows ``(axis, feature, loading, explained)`` with the axis' share of the variance."""
    from pyspark.sql import SparkSession
    spark, shares = SparkSession.getActiveSession(), _pca_of(fitted).explainedVariance.toArray()
    rows = [(f"pc{a + 1}", name, round(x, digits), round(float(shares[a]), digits))
            for a, axis in enumerate(loadings(fitted)) for name, x in zip(names, axis)]
    return spark.createDataFrame(rows, "axis string, feature string, loading double, explained double")


def raw_importances(fitted: PipelineModel, models: dict[str, object], names: Sequence[str],
                    columns: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows ``(model, feature, importance)`` over raw features instead of PCA axes.

    An axis' importance is shared out by its squared loadings, which add up
    to one, so a model's importances still add up to one. ``columns`` maps a
    raw column to the slot names it was encoded into; their shares add up.
    """
    from pyspark.sql import SparkSession
    vectors = loadings(fitted)
    owner = {slot: raw for raw, slots in (columns or {}).items() for slot in slots}
    rows = []
    for model, estimator in models.items():
        if not hasattr(estimator, "featureImportances"):
            continue
        total: dict[str, float] = {}
        for weight, axis in zip(estimator.featureImportances.toArray(), vectors):
            for name, x in zip(names, axis):
                raw = owner.get(name, name)
                total[raw] = total.get(raw, 0.0) + float(weight) * x * x
        rows += [(model, raw, value) for raw, value in total.items()]
    return SparkSession.getActiveSession().createDataFrame(rows, "model string, feature string, importance double")


# -------------------------------------------------------------- permutation

def permuted(df: DataFrame, column: str, key: str, seed: int = 42) -> DataFrame:
    """``df`` with the values of ``column`` dealt to other rows: the row that is i-th by one salted hash of
    ``key`` gets the value of the row that is i-th by another. ``key`` is unique and not NULL.

    Both ranks are distributed (``global_rank``), and the values move by
    equi-joins on rank and key; nothing is shuffled on the driver.
    """
    slim = df.select(F.col(key).alias("_key"), F.col(column).alias("_value"))

    def by(salt: int, keep: str, out: str) -> DataFrame:
        rows = slim.withColumn("_h", F.expr(salted_md5_sql("_key", salt)))
        return global_rank(rows, ["_h", "_key"], "_rank").select("_rank", F.col(keep).alias(out))

    dealt = by(seed, "_key", "_to").join(by(seed + 1, "_value", "_new"), "_rank").select("_to", "_new")
    return df.join(dealt, F.col(key) == F.col("_to")).withColumn(column, F.col("_new")).drop("_to", "_new")


def permutation_importance(df: DataFrame, predict: Callable[[DataFrame], DataFrame], columns: Sequence[str],
                           key: str = "job_id", label: str = "label", seed: int = 42, digits: int = 6) -> DataFrame:
    """Rows ``(feature, rmse, rmse_permuted, importance)`` (M13): how much the error of ``predict`` (a frame
    in, the same with ``prediction`` out) grows when a raw column's values are dealt to other rows."""
    def rmse(rows: DataFrame) -> DataFrame:
        e = F.col("prediction") - F.col(label)
        return predict(rows).agg(F.sqrt(F.avg(e * e)).alias("r"))

    out, base = None, rmse(df).scalar()
    for c in columns:
        row = rmse(permuted(df, c, key, seed)).select(
            F.lit(c).alias("feature"), F.round(base, digits).alias("rmse"), F.round("r", digits).alias("rmse_permuted"),
            F.round(F.col("r") - base, digits).alias("importance"))
        out = row if out is None else out.unionByName(row)
    return out
