import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator

from jobscope.operators import ml
from jobscope.plans import catalog as C

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def split(spark):
    train, test = C._train_test(spark, SF_SMALL)
    return train.cache(), test.cache()


def test_hash_split_is_disjoint_and_stable(spark, split):
    train, test = split
    a = {r.job_id for r in train.select("job_id").collect()}
    b = {r.job_id for r in test.select("job_id").collect()}
    assert a and b and not (a & b)
    again = C._training(spark, SF_SMALL).repartition(7)
    again_train = {r.job_id for r in again.where("split = 'train'").select("job_id").collect()}
    assert again_train == a


def test_minmax_matches_formula(split):
    train, _ = split
    cols = ["node_num", "gpu_num", "cpu_num", "duration"]
    got = ml.minmax_scaled(train, cols).toPandas().set_index("job_id").sort_index()
    pdf = train.select("job_id", *cols).toPandas().set_index("job_id").sort_index()
    for c in cols:
        lo, hi = pdf[c].min(), pdf[c].max()
        want = (pdf[c] - lo) / (hi - lo) if hi > lo else pdf[c] * 0 + 0.5
        assert np.allclose(got[f"{c}_scaled"], want, atol=1e-12)


def test_constant_column_scales_to_half(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0)], "job_id string, x double")
    assert {r.x_scaled for r in ml.minmax_scaled(df, ["x"]).collect()} == {0.5}


def test_string_index_order(spark):
    df = spark.createDataFrame([(str(i), u) for i, u in enumerate(["b", "a", "b", "c", "a", "10", "9"])],
                               "job_id string, user string")
    got = {r.job_id: r.user_index for r in ml.string_indexes(df, ["user"]).collect()}
    # frequency descending, ties alphabetical ("10" < "9" < "c" as text)
    order = {"a": 0.0, "b": 1.0, "10": 2.0, "9": 3.0, "c": 4.0}
    users = ["b", "a", "b", "c", "a", "10", "9"]
    assert got == {str(i): order[u] for i, u in enumerate(users)}


def test_metrics_agree_with_evaluator(spark, split):
    train, test = split
    model = ml.fit_pipeline(train, C.TEST_FEATURES, ml.ModelSpec("lr", {}))
    pred = model.transform(ml.with_group_statistics(test, train, C.TEST_FEATURES))
    m = ml.regression_metrics(pred, digits=None).first()
    rmse = RegressionEvaluator(metricName="rmse").evaluate(pred)
    mae = RegressionEvaluator(metricName="mae").evaluate(pred)
    assert m.rmse == pytest.approx(rmse, abs=1e-9)
    assert m.mae == pytest.approx(mae, abs=1e-9)
    assert m.rmse >= m.mae


def test_linear_fit_matches_least_squares(split):
    train, _ = split
    r = ml.linear_fit(train, "gpu_use_count").first()
    pdf = train.select("gpu_use_count", "label").toPandas()
    slope, icept = np.polyfit(pdf.gpu_use_count.astype(float), pdf.label, 1)
    assert r.slope == pytest.approx(slope, abs=1e-5)
    assert r.intercept == pytest.approx(icept, abs=1e-5)


def test_baseline_handles_unseen_group(spark):
    train = spark.createDataFrame([("Eval", 10.0), ("Eval", 20.0), ("Pretrain", 40.0)],
                                  "task_type string, label double")
    test = spark.createDataFrame([("Eval", 15.0), ("Other", 10.0)], "task_type string, label double")
    r = ml.group_mean_baseline(train, test).first()
    # Eval predicts 15 (error 0); Other falls back to the global mean 70/3
    assert r.n_test == 2
    assert r.mae == pytest.approx(round((70 / 3 - 10) / 2, 6))


def test_group_statistics(spark):
    spec = ml.FeatureSpec(grouped=("user",))
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0), (None, 4.0), (None, 5.0)],
                                  "user string, label double")
    own = {(r.user, r.label): (r.user_rows, r.user_mean)
           for r in ml.with_group_statistics(train, train, spec, own=True).collect()}
    assert own == {("a", 1.0): (1.0, 3.0), ("a", 3.0): (1.0, 1.0), ("b", 8.0): (0.0, pytest.approx(4.2)),
                   (None, 4.0): (1.0, 5.0), (None, 5.0): (1.0, 4.0)}
    test = spark.createDataFrame([("a",), ("new",), (None,)], "user string")
    assert {r.user: (r.user_rows, r.user_mean) for r in ml.with_group_statistics(test, train, spec).collect()} == {
        "a": (2.0, 2.0), "new": (0.0, pytest.approx(4.2)), None: (2.0, 4.5)}


def test_many_users(spark):
    """As many users as a large log has: every step still works, and none is left out."""
    n = 200_000
    rows = spark.range(n).selectExpr(
        "cast(id as string) AS job_id", "concat('u', id) AS user", "if(id % 2 = 0, 'Eval', 'Pretrain') AS task_type",
        "cast(id % 7 as double) AS gpu_num", "cast(id % 5 as double) AS label")
    got = ml.string_indexes(rows, ["user", "task_type"])
    r = got.selectExpr("count(distinct user_index) AS n", "max(user_index) AS most", "min(user_index) AS least").first()
    assert (r.n, r.most, r.least) == (n, n - 1.0, 0.0)
    spec = ml.FeatureSpec(label="label", numeric=("gpu_num",), pca_k=2)
    metrics, importances = ml.evaluate([ml.ModelSpec("rf", {"numTrees": 2, "maxDepth": 2, "seed": 1})],
                                       rows, rows, spec)
    assert {x.metric: x.value for x in metrics.collect()}["n_test"] == n and importances.count() == 2


def test_evaluate_models(split):
    train, test = split
    models = [ml.ModelSpec("lr", {}), ml.ModelSpec("rf", {"numTrees": 3, "maxDepth": 3, "seed": 1}),
              ml.ModelSpec("gbt", {"maxIter": 3, "maxDepth": 2, "seed": 1}),
              ml.ModelSpec("lr", {"regParam": 0.5}, name="ridge")]
    metrics, imp = ml.evaluate(models, train, test, C.TEST_FEATURES)
    rows = {(r.model, r.metric): r.value for r in metrics.collect()}
    assert {m for m, _ in rows} == {"lr", "rf", "gbt", "ridge"}
    for m in ("lr", "rf", "gbt", "ridge"):
        assert rows[(m, "rmse")] >= rows[(m, "mae")] >= 0
        assert rows[(m, "n_test")] == test.count()
    got = imp.collect()
    assert {r.model for r in got} == {"rf", "gbt"}
    for m in ("rf", "gbt"):
        assert sum(r.importance for r in got if r.model == m) == pytest.approx(1.0)


def test_no_job_id_or_state_features():
    spec = ml.FeatureSpec()
    assert "job_id" not in spec.categorical and "state" not in spec.categorical


def test_pca_is_the_closed_form_of_two_columns(split):
    train, _ = split
    spec = ml.FeatureSpec(numeric=("gpu_num", "duration"), categorical=(), grouped=(), pca_k=2)
    model = ml.fit_features(train, spec)
    x = np.array([r.features.toArray() for r in model.transform(train).select("features").collect()])
    (a, b), (_, d) = np.cov(x.T)
    root = np.sqrt((a - d) ** 2 / 4 + b * b)
    axes = model.stages[-1].pc.toArray()
    for k, value in enumerate(((a + d) / 2 + root, (a + d) / 2 - root)):
        want = np.array([b, value - a]) / np.hypot(b, value - a)
        assert np.allclose(np.abs(axes[:, k] @ want), 1.0, atol=1e-9)


def test_sample_rows(spark):
    df = spark.range(10000)
    got = ml.sample_rows(df, 1000, seed=7).count()
    assert 800 < got < 1200
    assert ml.sample_rows(df, 20000).count() == 10000


def test_pca_without_numeric_block(split):
    train, _ = split
    spec = ml.FeatureSpec(label="queue", numeric=(), grouped=(), pca_k=2)
    rows = ml.fit_features(train, spec).transform(train).select("pca_features").collect()
    assert len(rows) == train.count() and rows[0].pca_features.size == 2


def test_pipeline_saved_and_loaded(split, tmp_path):
    train, test = split
    model = ml.fit_pipeline(train, C.TEST_FEATURES, ml.ModelSpec("lr", {}))
    model.write().overwrite().save(f"file://{tmp_path}/model")
    rows = ml.with_group_statistics(test, train, C.TEST_FEATURES)
    got = [{r.job_id: r.prediction for r in m.transform(rows).collect()}
           for m in (model, PipelineModel.load(f"file://{tmp_path}/model"))]
    assert got[0] == got[1] and len(got[0]) == test.count()


def test_feature_names_without_pca(split):
    train, _ = split
    spec = ml.FeatureSpec(label="queue", numeric=("gpu_num",), pca_k=None)
    rows = ml.with_group_statistics(train, train, spec, own=True)
    model = ml.fit_features(rows, spec)
    assert len(ml.feature_names(model, spec)) >= model.transform(rows).first().features.size


def test_string_index_null_comes_last(spark):
    df = spark.createDataFrame([("1", "a"), ("2", None), ("3", "b"), ("4", "b")], "job_id string, user string")
    got = {r.job_id: r.user_index for r in ml.string_indexes(df, ["user"]).collect()}
    assert got == {"1": 1.0, "2": 2.0, "3": 0.0, "4": 0.0}
    assert ml.string_indexes(df.where("user = 'x'"), ["user"]).count() == 0


def test_estimators_pass_over_rows_dealt_over_all_cores(spark, split, monkeypatch):
    train, test = split
    seen, make = [], ml.make_estimator

    class Watched:
        def __init__(self, est):
            self.est = est

        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))
            return self.est.fit(rows)

    monkeypatch.setattr(ml, "make_estimator", lambda *a: Watched(make(*a)))
    monkeypatch.setattr(ml, "LEAST_ROWS", 10)
    ml.evaluate([ml.ModelSpec("lr", {})], train.coalesce(1), test, C.TEST_FEATURES)
    assert seen == [(spark.sparkContext.defaultParallelism, train.count())]
    monkeypatch.setattr(ml, "LEAST_ROWS", 10 ** 9)
    monkeypatch.setattr(ml, "MOST_ROWS", 100)
    assert ml.spread(train.coalesce(1), train.count()).rdd.getNumPartitions() == -(-train.count() // 100)
