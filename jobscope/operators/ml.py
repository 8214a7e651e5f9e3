"""Job-duration models on Spark ML.

Feature pipeline: numeric columns and group statistics -> ``VectorAssembler``
-> ``MinMaxScaler``; categorical columns -> ``StringIndexer`` ->
``OneHotEncoder``; everything -> ``VectorAssembler`` -> optional
``ml.feature.PCA`` -> regressor (linear, random forest or gradient-boosted
trees), all in one ``Pipeline`` that can be saved, loaded and applied.

Scale notes:
* the split is a hash of the job id, so it is the same for any
  partitioning and any re-execution after an executor loss;
* a column whose values grow with the data (``user``) enters as statistics
  of its training rows, joined on by a stage of the pipeline: how many they
  are and their mean label.
  The feature width, and with it PCA's width x width matrix and the label
  lists on the driver, depends only on the ``categorical`` columns, which
  are for closed vocabularies such as the job type;
* the training frame is persisted for the many passes estimators make
  and released when fitting is done.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, MinMaxScaler, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import number_sql
from ..functions.states import lit_sql, q
from ..session import scratch_path
from .group_stats import OWN_COL, GroupStatistics

HASH_SPACE = 2 ** 32
#: Training rows of a partition while estimators fit: fewer are not worth a task of their own, more are split.
LEAST_ROWS, MOST_ROWS = 20_000, 2_000_000


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns feed the model. Defaults follow the original study:
    predict ``duration`` of completed jobs from resources and queue delay."""
    label: str = "duration"
    numeric: tuple[str, ...] = ("node_num", "gpu_num", "cpu_num", "queue")
    categorical: tuple[str, ...] = ("task_type",)   # one-hot: closed vocabularies
    grouped: tuple[str, ...] = ("user",)            # any number of values: statistics of their rows
    pca_k: int | None = 3

    @property
    def numeric_inputs(self) -> list[str]:
        return [*self.numeric, *(f"{c}_{s}" for c in self.grouped for s in ("rows", "mean"))]

    @property
    def features_col(self) -> str:
        return "pca_features" if self.pca_k else "features"


@dataclass(frozen=True)
class ModelSpec:
    kind: str                       # "lr" | "rf" | "gbt"
    params: dict = field(default_factory=dict)
    name: str = ""                  # tells two specs of one kind apart in the reports

    def __post_init__(self):
        object.__setattr__(self, "name", self.name or self.kind)


# Estimator settings of the original study (seeded here).
STUDY_MODELS = (
    ModelSpec("gbt", {"maxIter": 50, "maxDepth": 10, "seed": 42}),
    ModelSpec("rf", {"numTrees": 15, "maxDepth": 15, "seed": 42}),
    ModelSpec("lr", {}),
)


# ------------------------------------------------------------------ split

def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows without replacement (M14): a Bernoulli sample with
    fraction n / count — one counting pass, then a per-row coin flip; the
    result size is random around ``n``, as with ``DataFrame.sample``."""
    total = df.count()
    return df if total <= n else df.sample(withReplacement=False, fraction=n / total, seed=seed)


def hash_unit(key) -> F.Column:
    """A stable pseudo-random integer in [0, 2^32) from md5 of the key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")


def hash_sample(df: DataFrame, key: str = "job_id", fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """The rows whose salted key hash is in the lowest ``fraction`` (M14): like
    ``hash_split``, the same for any partitioning and reproducible in SQL."""
    salted = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    return df.where(hash_unit(salted) < int(round(fraction * HASH_SPACE)))


def hash_split(df: DataFrame, key: str = "job_id", train_fraction: float = 0.8,
               seed: int = 42, out: str = "split") -> DataFrame:
    """Tag rows ``train``/``test`` by a salted hash of ``key``.

    Unlike ``randomSplit`` the outcome does not depend on partitioning or
    row order, survives recomputation, and is reproducible in SQL.
    """
    threshold = int(round(train_fraction * HASH_SPACE))
    h = hash_unit(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn(out, F.when(h < threshold, "train").otherwise("test"))


# --------------------------------------------------------------- features

def _group_stage(spec: FeatureSpec) -> GroupStatistics:
    return GroupStatistics(inputCols=list(spec.grouped), labelCol="label", ownCol=OWN_COL)


def with_group_statistics(df: DataFrame, train: DataFrame, spec: FeatureSpec,
                          own: bool = False) -> DataFrame:
    """``df`` with ``<column>_rows`` and ``<column>_mean`` of each ``grouped``
    column: the number of training rows with its value and their mean label
    (the mean of all training rows for a value without any).

    ``own=True`` is for the training rows themselves: a row's own label is
    taken out of its statistics. The pipelines hold this step as a stage
    (``group_stats.GroupStatistics``); this is the same for a single frame.
    """
    if not spec.grouped:
        return df
    model = _group_stage(spec).fit(train)
    if not own:
        return model.transform(df.drop(OWN_COL))
    return model.transform(df.withColumn(OWN_COL, F.lit(True))).drop(OWN_COL)


def feature_stages(spec: FeatureSpec) -> list:
    stages = [_group_stage(spec)] if spec.grouped else []
    parts = []
    if spec.numeric_inputs:
        stages += [VectorAssembler(inputCols=spec.numeric_inputs, outputCol="numeric_features",
                                   handleInvalid="keep"),
                   MinMaxScaler(inputCol="numeric_features", outputCol="scaled_numeric")]
        parts.append("scaled_numeric")
    if spec.categorical:
        cats = list(spec.categorical)
        # one indexer and one encoder for all columns: one counting pass
        stages += [StringIndexer(inputCols=cats, outputCols=[f"{c}_index" for c in cats],
                                 handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}_index" for c in cats],
                                 outputCols=[f"{c}_vec" for c in cats], handleInvalid="keep")]
        parts += [f"{c}_vec" for c in cats]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    if spec.pca_k:
        stages.append(PCA(k=spec.pca_k, inputCol="features", outputCol="pca_features"))
    return stages


def make_estimator(model: ModelSpec, spec: FeatureSpec, prediction: str = "prediction"):
    common = {"featuresCol": spec.features_col, "labelCol": "label",
              "predictionCol": prediction}
    if model.kind == "gbt":
        return GBTRegressor(**common, **model.params)
    if model.kind == "rf":
        return RandomForestRegressor(**common, **model.params)
    if model.kind == "lr":
        return LinearRegression(**common, **model.params)
    raise ValueError(f"unknown model kind {model.kind!r}")


def fit_features(train: DataFrame, spec: FeatureSpec) -> PipelineModel:
    """Fit the feature stages (group statistics, scaler, indexers, encoders, PCA) on training rows."""
    return Pipeline(stages=feature_stages(spec)).fit(train.withColumn(OWN_COL, F.lit(True)))


def fit_pipeline(train: DataFrame, spec: FeatureSpec, model: ModelSpec) -> PipelineModel:
    """Fit features and one estimator on the training rows (M10): one
    ``PipelineModel``. It holds all that it learnt, the group statistics
    too, so it can be saved, loaded in another session and applied to rows
    of the job log without the training frame."""
    rows = train.withColumn(OWN_COL, F.lit(True)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=[*feature_stages(spec), make_estimator(model, spec)]).fit(rows)
    finally:
        rows.unpersist()


# ---------------------------------------------------------------- metrics

def regression_metrics(pred: DataFrame, label: str = "label",
                       prediction: str = "prediction", digits: int | None = 6) -> DataFrame:
    """n, RMSE and MAE in a single aggregation pass."""
    e = F.col(prediction) - F.col(label)
    rmse, mae = F.sqrt(F.avg(e * e)), F.avg(F.abs(e))
    if digits is not None:
        rmse, mae = F.round(rmse, digits), F.round(mae, digits)
    return pred.agg(F.count(F.lit(1)).alias("n_test"), rmse.alias("rmse"), mae.alias("mae"))


def metrics_rows(scored: DataFrame, predictions: dict[str, str], label: str = "label",
                 digits: int = 6) -> DataFrame:
    """Rows ``(model, metric, value)`` for all models at once (S8): their
    ``predictions`` (model -> column) are read in one pass."""
    aggs, rows = ["count(1) AS _n"], []
    for i, (model, column) in enumerate(predictions.items()):
        e = f"({q(column)} - {q(label)})"
        aggs += [f"round(sqrt(avg({e} * {e})), {digits}) AS _r{i}", f"round(avg(abs({e})), {digits}) AS _a{i}"]
        rows += [f"struct({lit_sql(model)} AS model, {lit_sql(metric)} AS metric, {value} AS value)"
                 for metric, value in (("rmse", f"_r{i}"), ("mae", f"_a{i}"), ("n_test", "CAST(_n AS double)"))]
    return scored.agg(*[F.expr(a) for a in aggs]).selectExpr(f"inline(array({', '.join(rows)}))")


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt evenly over all cores. Boosting passes over its rows once per level of every
    tree, and input files and joins leave small rows in fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(min(cores, rows // LEAST_ROWS), -(-rows // MOST_ROWS))
    return df.repartition(n) if n > 1 else df


def evaluate(models: Sequence[ModelSpec], train: DataFrame, test: DataFrame,
             spec: FeatureSpec, parallelism: int = 3) -> tuple[DataFrame, DataFrame]:
    """Fit every model on ``train``, score on ``test``.

    The feature stages are fitted once and shared; the training vectors are
    dealt over all cores and persisted while the estimators make their passes over them; up to
    ``parallelism`` estimators fit at once from driver threads (as
    ``CrossValidator(parallelism=...)`` does), so their jobs share the
    cluster instead of queueing. The fitted models are chained, each adding
    its own prediction column, so the test rows are read once. Returns
    ``(metrics, importances)``: rows ``(model, metric, value)`` and
    ``(model, feature, importance)`` (tree models only; features are the
    PCA axes when PCA is on, else the assembled feature slots). Models must
    differ in name.
    """
    spark = train.sparkSession
    columns = {m.name: f"prediction_{i}" for i, m in enumerate(models)}
    if len(columns) < len(models):
        raise ValueError("two models have one name")
    rows = train.withColumn(OWN_COL, F.lit(True)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        feats = fit_features(rows, spec)
        names = feature_names(feats, spec)
        vectors = spread(feats.transform(rows).select(spec.features_col, "label"), rows.count()) \
            .persist(StorageLevel.MEMORY_AND_DISK)
        try:
            workers = max(1, min(parallelism, len(models)))
            with ThreadPoolExecutor(max_workers=workers) as pool:
                ests = list(pool.map(lambda m: make_estimator(m, spec, columns[m.name]).fit(vectors), models))
        finally:
            vectors.unpersist()
    finally:
        rows.unpersist()
    scored = PipelineModel([feats, *ests]).transform(test)
    importances = [(m.name, names[i], float(v)) for m, est in zip(models, ests)
                   if hasattr(est, "featureImportances")
                   for i, v in enumerate(est.featureImportances.toArray())]
    return metrics_rows(scored, columns), spark.createDataFrame(
        importances, "model string, feature string, importance double")


def feature_names(fitted: PipelineModel, spec: FeatureSpec) -> list[str]:
    if spec.pca_k:
        return [f"pc{i + 1}" for i in range(spec.pca_k)]
    names = spec.numeric_inputs
    for st in fitted.stages:
        if hasattr(st, "labelsArray"):
            # the encoder keeps a slot per label; the one for unseen values is the dropped last
            for c, labels in zip(st.getOrDefault("inputCols"), st.labelsArray):
                names += [f"{c}={v}" for v in labels] + [f"{c}=other"]
    return names


# --------------------------------------------------------- single stages

def minmax_scaled(train: DataFrame, cols: Sequence[str], key: str = "job_id",
                  suffix: str = "_scaled") -> DataFrame:
    """Fit ``MinMaxScaler`` on ``train`` and return ``key`` plus one scaled
    column per input (M1, M2)."""
    asm = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="keep")
    scaler = MinMaxScaler(inputCol="_v", outputCol="_s")
    model = Pipeline(stages=[asm, scaler]).fit(train)
    arr = vector_to_array(F.col("_s"))
    return model.transform(train).select(
        key, *[arr[i].alias(f"{c}{suffix}") for i, c in enumerate(cols)])


def string_indexes(train: DataFrame, cols: Sequence[str], key: str = "job_id") -> DataFrame:
    """Index of each value by descending frequency, ties in text order; NULL
    gets the index after the last (M3). Output: ``key`` and ``<col>_index``.

    The order is ``StringIndexer``'s, but no value reaches the driver, so a
    column may have any number of them: the values are counted (with
    map-side partial sums), range-partitioned by frequency and text, and
    numbered within each range. Only the ranges' sizes, one row per range
    and column, go to the driver to make the offsets.
    """
    spark = train.sparkSession
    cells = ", ".join(f"struct({lit_sql(c)} AS col, CAST({q(c)} AS string) AS value)" for c in cols)
    counts = train.selectExpr(f"inline(array({cells}))").where("value IS NOT NULL") \
        .groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "string-index")
    counts.repartitionByRange("col", F.desc("n"), "value").withColumn("range", F.spark_partition_id()) \
        .write.parquet(path)
    ranged = spark.read.schema("col string, value string, n long, range int").parquet(path)
    sizes = {(r.col, r.range): r.size for r in
             ranged.groupBy("col", "range").agg(F.count(F.lit(1)).alias("size")).collect()}
    offsets, seen = [], dict.fromkeys(cols, 0)
    for (col, part), size in sorted(sizes.items()):
        offsets.append((col, part, seen[col]))
        seen[col] += size
    before = spark.createDataFrame(offsets, "col string, range int, before long")
    at = F.row_number().over(Window.partitionBy("col", "range").orderBy(F.desc("n"), "value"))
    numbered = ranged.withColumn("at", at).join(before, ["col", "range"]) \
        .select("col", "value", (F.col("at") - 1 + F.col("before")).cast("double").alias("index"))
    out = train.select(key, *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(cols)])
    for i, c in enumerate(cols):
        own = numbered.where(F.col("col") == c).select(F.col("value").alias(f"_v{i}"), F.col("index").alias(f"{c}_index"))
        out = out.join(own, F.col(f"_{i}") == F.col(f"_v{i}"), "left") \
            .withColumn(f"{c}_index", F.coalesce(f"{c}_index", F.lit(float(seen[c]))))
    return out.select(key, *[f"{c}_index" for c in cols])


def group_mean_baseline(train: DataFrame, test: DataFrame, group: str = "task_type",
                        label: str = "label", scale: int | None = None) -> DataFrame:
    """Predict the training mean of the label per ``group`` (global mean for
    a group unseen in training) and score it on ``test`` (M12 baseline).

    One aggregation of the training rows gives sums (exact decimals with
    ``scale``) and counts per group; the global mean is summed from those few rows, so
    the training rows are read once. The join to the test rows is against
    one row per group, and AQE decides how on its actual size.
    """
    sums = train.groupBy(group).agg(F.expr(f"sum({number_sql(q(label), scale)})").alias("_s"),
                                    F.count(label).alias("_n"))
    means = sums.select(group, (F.col("_s").cast("double") / F.col("_n").cast("double"))
                        .alias("_pred"))
    overall = sums.agg(F.sum("_s").cast("double") / F.sum("_n").cast("double")).scalar()
    scored = (test.join(means, on=group, how="left")
              .withColumn("prediction", F.coalesce(F.col("_pred"), overall)))
    return regression_metrics(scored, label=label)


def linear_fit(train: DataFrame, feature: str, label: str = "label",
               digits: int = 6) -> DataFrame:
    """Ordinary least squares of ``label`` on one feature with Spark ML's
    normal-equation solver; one row ``slope, intercept`` (M9)."""
    asm = VectorAssembler(inputCols=[feature], outputCol="_x")
    lr = LinearRegression(featuresCol="_x", labelCol=label, solver="normal", regParam=0.0,
                          standardization=False, fitIntercept=True)
    model = lr.fit(asm.transform(train.select(feature, label)))
    spark = train.sparkSession
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), digits), round(float(model.intercept), digits))],
        "slope double, intercept double")
