"""Self-contained pipelines, feature slots, PCA loadings, permutation importance, ranks and exact samples."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from jobscope.operators import explain, ml
from jobscope.operators.group_stats import OWN_COL, GroupStatistics, GroupStatisticsModel
from jobscope.operators.ranking import exact_sample, global_rank, merge_samples


@pytest.fixture(scope="module")
def jobs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        user = rng.choice(["a", "b", "c", "d", None])
        rows.append((i, user, rng.choice(["Eval", "Pretrain"]), float(rng.randrange(9)), float(rng.randrange(5)), 10.0 * (user == "a") + rng.random()))
    rows.append((200, "alone", "Eval", 1.0, 1.0, 5.0))
    return spark.createDataFrame(rows, "job_id long, user string, task_type string, x double, y double, label double").cache()


SPEC = ml.FeatureSpec(label="label", numeric=("x", "y"), categorical=("task_type",), grouped=("user",), pca_k=2)


# -- M10

def brute_statistics(rows, value, own=None):
    labels = [r.label for r in rows if r.user == value and r is not own]
    return float(len(labels)), sum(labels) / len(labels) if labels else sum(r.label for r in rows) / len(rows)


def test_group_statistics_leave_a_training_row_out(spark, jobs):
    rows = jobs.collect()
    model = GroupStatistics(inputCols=["user"]).fit(jobs)
    for r in model.transform(jobs.withColumn(OWN_COL, F.lit(True))).collect():
        own = next(x for x in rows if x.job_id == r.job_id)
        n, mean = brute_statistics(rows, r.user, own)
        assert r.user_rows == n and r.user_mean == pytest.approx(mean, abs=1e-12)
    new = spark.createDataFrame([("a",), ("new",), (None,)], "user string")
    got = {r.user: (r.user_rows, r.user_mean) for r in model.transform(new).collect()}
    assert got == {u: (n, pytest.approx(m, abs=1e-12)) for u, (n, m) in ((u, brute_statistics(rows, u)) for u in ("a", "new", None))}


def test_mixed_marks_and_missing_labels(spark, jobs):
    rows, model = jobs.collect(), GroupStatistics(inputCols=["user"]).fit(jobs)
    mixed = spark.createDataFrame([("a", True, 3.0), ("a", False, 3.0), ("a", None, 3.0), ("a", True, None)], f"user string, {OWN_COL} boolean, label double")
    n, mean = brute_statistics(rows, "a")
    got = [(r.user_rows, r.user_mean) for r in model.transform(mixed.coalesce(1)).collect()]
    assert sorted(g[0] for g in got) == [n - 1, n, n, n]
    assert min(got)[1] == pytest.approx((n * mean - 3.0) / (n - 1))


def test_group_statistics_of_no_rows(jobs):
    model = GroupStatistics(inputCols=["user"]).fit(jobs.where("false"))
    assert [(r.user_rows, r.user_mean) for r in model.transform(jobs.limit(1)).collect()] == [(0.0, 0.0)]


@pytest.mark.parametrize("kind,params", [("lr", {}), ("rf", {"numTrees": 2, "maxDepth": 3, "seed": 1})])
def test_saved_pipeline_scores_without_the_training_frame(spark, jobs, scratch, kind, params):
    train, test = jobs.where("job_id % 4 > 0"), jobs.where("job_id % 4 = 0")
    model = ml.fit_pipeline(train, SPEC, ml.ModelSpec(kind, params))
    want = {r.job_id: r.prediction for r in model.transform(test).collect()}
    model.save(scratch)
    with_tables = [s for s in model.stages if isinstance(s, GroupStatisticsModel)]
    assert len(with_tables) == 1
    other = spark.newSession()
    loaded = PipelineModel.load(scratch)
    fresh = other.createDataFrame(test.drop("label").toPandas()[["job_id", "user", "task_type", "x", "y"]].astype({"user": object}))
    fresh = fresh.withColumn("user", F.when(F.col("user") != "None", F.col("user")))
    got = {r.job_id: r.prediction for r in loaded.transform(fresh).collect()}
    assert got == pytest.approx(want, rel=1e-9) and len(got) == test.count()
    assert any("/tables/0/" in f for f in loaded.transform(fresh).inputFiles())  # the statistics come from the saved pipeline


def test_estimator_is_saved_and_loaded(spark, jobs, scratch):
    stage = GroupStatistics(inputCols=["user"], labelCol="label", ownCol="mine")
    stage.save(scratch)
    again = GroupStatistics.load(scratch)
    assert again.getInputCols() == ["user"] and again.getOrDefault("ownCol") == "mine"
    assert again.fit(jobs).transform(jobs.limit(3)).columns[-2:] == ["user_rows", "user_mean"]


def test_pipeline_with_group_statistics_equals_the_single_step(spark, jobs):
    train, test = jobs.where("job_id % 4 > 0"), jobs.where("job_id % 4 = 0")
    stages = [VectorAssembler(inputCols=["user_mean"], outputCol="v"), LinearRegression(featuresCol="v", labelCol="label", solver="normal")]
    whole = Pipeline(stages=[GroupStatistics(inputCols=["user"]), *stages]).fit(train.withColumn(OWN_COL, F.lit(True)))
    spec = ml.FeatureSpec(label="label", numeric=(), categorical=(), grouped=("user",), pca_k=None)
    parts = Pipeline(stages=stages).fit(ml.with_group_statistics(train, train, spec, own=True))
    a = {r.job_id: r.prediction for r in whole.transform(test).collect()}
    b = {r.job_id: r.prediction for r in parts.transform(ml.with_group_statistics(test, train, spec)).collect()}
    assert a == pytest.approx(b, rel=1e-9)


# -- M4, M5

def test_slots_carry_metadata_names(jobs):
    spec = ml.FeatureSpec(label="label", numeric=("x", "y"), categorical=("task_type",), grouped=(), pca_k=None)
    fitted = ml.fit_features(jobs, spec)
    made = fitted.transform(jobs)
    assert explain.slot_names(made, "features")[2:4] in (["task_type_vec_Eval", "task_type_vec_Pretrain"], ["task_type_vec_Pretrain", "task_type_vec_Eval"])
    got = {(r.job_id, r.name): r.value for r in explain.feature_slots(made, names=ml.feature_names(fitted, spec)).collect()}
    for r in jobs.collect():
        assert got[r.job_id, f"task_type={r.task_type}"] == 1.0
        assert got.get((r.job_id, "x"), 0.0) == pytest.approx(r.x / 8)
    assert len(got) == sum(1 + (r.x != 0) + (r.y != 0) for r in jobs.collect())


def test_slots_of_bare_vectors(spark):
    df = spark.createDataFrame([(1, Vectors.sparse(4, {1: 2.0, 3: -1.0})), (2, Vectors.dense([0.0, 5.0])), (3, Vectors.dense([]))], ["job_id", "v"])
    got = sorted(tuple(r) for r in explain.feature_slots(df, "v").collect())
    assert got == [(1, 1, "slot_1", 2.0), (1, 3, "slot_3", -1.0), (2, 1, "slot_1", 5.0)]
    assert explain.feature_slots(df.where("false"), "v").count() == 0


# -- M6, M13

def test_loadings_and_raw_importances(jobs):
    fitted = ml.fit_features(jobs, SPEC)
    rows = np.array([r.features.toArray() for r in fitted.transform(jobs.withColumn(OWN_COL, F.lit(True))).select("features").collect()])
    values, vectors = np.linalg.eigh(np.cov(rows.T))
    got = np.array(explain.loadings(fitted))
    for axis, want in zip(got, vectors.T[::-1]):
        assert abs(axis @ want) == pytest.approx(1, abs=1e-9) and axis[np.argmax(np.abs(axis))] > 0
    names = explain.slot_names(fitted.transform(jobs), "features")
    table = explain.pca_loadings(fitted, names)
    assert table.count() == 2 * rows.shape[1]
    assert {round(r.explained, 5) for r in table.collect()} == {round(v / values.sum(), 5) for v in values[-2:]}
    vectors_ = fitted.transform(jobs.withColumn(OWN_COL, F.lit(True)))
    forest = ml.make_estimator(ml.ModelSpec("rf", {"numTrees": 3, "maxDepth": 3, "seed": 2}), SPEC).fit(vectors_)
    line = ml.make_estimator(ml.ModelSpec("lr", {}), SPEC).fit(vectors_)
    raw = {"task_type": [n for n in names if n.startswith("task_type")]}
    found = {r.feature: r.importance for r in explain.raw_importances(fitted, {"rf": forest, "lr": line}, names, raw).collect()}
    weights = forest.featureImportances.toArray()
    want = dict(zip(names, (weights[:, None] * got**2).sum(axis=0)))
    assert sum(found.values()) == pytest.approx(1) and "task_type" in found
    assert found["task_type"] == pytest.approx(sum(want[n] for n in raw["task_type"]))


def test_loadings_need_a_pca_stage(jobs):
    fitted = ml.fit_features(jobs, ml.FeatureSpec(label="label", numeric=("x",), categorical=(), grouped=(), pca_k=None))
    with pytest.raises(ValueError, match="no PCA"):
        explain.loadings(fitted)


def by_hash(rows, seed):
    return sorted(rows, key=lambda r: (hashlib.md5(f"{seed}:{r.job_id}".encode()).hexdigest(), r.job_id))


def test_permutation_against_brute_force(jobs):
    rows = jobs.collect()
    want = {a.job_id: b.x for a, b in zip(by_hash(rows, 42), by_hash(rows, 43))}
    for parts in (1, 5):
        got = explain.permuted(jobs.repartition(parts), "x", "job_id")
        assert got.columns == jobs.columns
        assert {r.job_id: (r.x, r.y, r.label) for r in got.collect()} == {r.job_id: (want[r.job_id], r.y, r.label) for r in rows}
    predict = lambda df: df.withColumn("prediction", F.expr("2 * x + 1"))
    rmse = lambda f: np.sqrt(np.mean([(f(r) - r.label) ** 2 for r in rows]))
    base, dealt = rmse(lambda r: 2 * r.x + 1), rmse(lambda r: 2 * want[r.job_id] + 1)
    got = {r.feature: (r.rmse, r.rmse_permuted, r.importance) for r in explain.permutation_importance(jobs, predict, ["x", "y"]).collect()}
    assert got["x"] == pytest.approx((base, dealt, dealt - base), abs=2e-6)
    assert got["y"] == pytest.approx((base, base, 0), abs=2e-6)  # the model does not look at y


# -- ranks, M14

def test_global_rank_is_the_sorted_place(spark):
    rng = random.Random(1)
    values = [rng.randrange(50) for _ in range(500)] + [None] * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long").repartition(6)
    got = {r.id: r["rank"] for r in global_rank(df, ["v", "id"]).collect()}
    want = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i], i))
    assert [got[i] for i in want] == list(range(1, len(values) + 1))
    assert global_rank(df.where("false"), ["v", "id"]).count() == 0


def test_exact_sample_for_any_partitioning(spark, jobs):
    rows = by_hash(jobs.collect(), 7)
    for parts in (1, 3, 8):
        for k in (0, 1, 17, 201, 500):
            got = exact_sample(jobs.repartition(parts), "job_id", k, 7)
            assert {r.job_id for r in got.collect()} == {r.job_id for r in rows[:k]} and got.count() == min(k, 201)
    plan = exact_sample(jobs, "job_id", 17, 7)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    with pytest.raises(ValueError):
        exact_sample(jobs, "job_id", -1)


def test_samples_merge(spark, jobs):
    whole = {tuple(r) for r in exact_sample(jobs, "job_id", 30).collect()}
    days = [exact_sample(jobs.where(f"job_id % 3 = {d}"), "job_id", 30) for d in range(3)]
    assert {tuple(r) for r in merge_samples(days, "job_id", 30).collect()} == whole


def test_sample_of_repeated_and_null_keys(spark):
    rows = [(1, "a")] * 5 + [(None, "x"), (None, "y"), (2, "b")]
    df = spark.createDataFrame(rows, "job_id long, v string")
    assert exact_sample(df, "job_id", 7).count() == 7
    one = [[tuple(r) for r in exact_sample(df.repartition(p), "job_id", 7).collect()] for p in (1, 4)]
    assert one[0] == one[1] and one[0][-1][0] is None
