import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import models, svc, trees
from tessera.operators.kernels import KernelClassification, rff_weights
from tessera.operators.models import TrainConfig, compare_models


def rows_of(spark, n, classes, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (2 * x[:, :classes] + rng.normal(size=(n, classes))).argmax(1)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, label double")
    return x, y, df.select(array_to_vector("x").alias("scaled"), "label").repartition(4).cache()


def test_as_good_as_mllib_in_one_set_of_passes(spark, monkeypatch):
    x, y, df = rows_of(spark, 600, 3)
    monkeypatch.setattr(svc, "DIRECT", 2)  # fewer than partitions
    monkeypatch.setattr(svc, "GROUPS", 2)
    fit = svc.fit_svc(df, "scaled", "label", 3, 4, 32, 0.25, 42)
    assert fit.passes < 130  # and not so many for each class
    w, b = rff_weights(4, 32, 0.25, 42)
    z = np.sqrt(2 / 32) * np.cos(x @ w + b)
    frame = spark.createDataFrame([(a.tolist(), float(c)) for a, c in zip(z, y, strict=True)], "z array<double>, label double").select(array_to_vector("z").alias("rff"), "label").coalesce(2).cache()
    theirs = OneVsRest(classifier=LinearSVC(featuresCol="rff", regParam=1 / 600, maxIter=100), featuresCol="rff", parallelism=3).fit(frame)

    def objective(weights, intercept, k):
        return np.maximum(0, 1 - np.where(y == k, 1, -1) * (z @ weights + intercept)).mean() + ((weights * z.std(0, ddof=1)) ** 2).sum() / 1200

    for k in range(3):
        ours = objective(fit.weights[k], fit.intercepts[k], k)
        assert ours == pytest.approx(fit.objectives[k], rel=1e-4)
        assert ours < 1.005 * objective(theirs.models[k].coefficients.toArray(), theirs.models[k].intercept, k)
    head = KernelClassification(inputCol="scaled", outputCol="prediction", inputDim=4, gamma=0.25, weights=fit.weights.ravel().tolist(), intercepts=fit.intercepts.tolist(), seed=42)
    assert head.transform(df).where(F.col("prediction") == F.col("label")).count() >= 590 * (y == (z @ fit.weights.T + fit.intercepts).argmax(1)).mean()


def test_constant_features_and_a_class_without_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0], float(i % 2)) for i in range(60)], "x array<double>, label double").select(array_to_vector("x").alias("scaled"), "label").coalesce(1)
    fit = svc.fit_svc(df, "scaled", "label", 3, 2, 8, 0.5, 42)
    assert np.isfinite(fit.weights).all() and np.isfinite(fit.intercepts).all() and fit.objectives[2] < 1e-6


def test_many_classes_of_a_large_table(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    df = spark.createDataFrame([(i, float(a), float(b), "abc"[int(a > 0) + int(b > 0.5)]) for i, (a, b) in enumerate(x.tolist())], "id long, a double, b double, y string")
    monkeypatch.setattr(models, "MLLIB_ROWS", 100)
    res = compare_models(df, TrainConfig("y", "multiclass", split_keys=("id",), models=("SVC_RFF",), rff_dim=64))
    assert not res.skipped and res.best_metrics["accuracy"] > 0.85
    model = res.models["SVC_RFF"]
    assert isinstance(model.stages[-1], KernelClassification)  # one set of passes for all classes
    model.write().overwrite().save(f"{tmp_path}/m")
    some = df.limit(20).select(array_to_vector(F.array("a", "b", F.lit(0.0))).alias("features"))
    again = PipelineModel.load(f"{tmp_path}/m")
    if model.stages[0].mean.size == 3:
        assert [r.prediction for r in again.transform(some).collect()] == [r.prediction for r in model.transform(some).collect()]


def test_histograms_and_places_as_counted_row_by_row():
    rng = np.random.default_rng(2)
    layout = trees.Layout([np.arange(6.0), np.array([0.5]), np.zeros(0), np.array([0.5])])
    columns = np.stack([rng.integers(0, 7, 500), rng.integers(0, 2, 500), np.zeros(500, int), rng.random(500) < 0.1]).astype(np.uint8)
    feature, cut, left = np.array([0, 1, -1, -1, 3, -1, -1]), np.array([3, 0, 0, 0, 0, 0, 0]), np.array([1, 3, 0, 0, 5, 0, 0])
    at, weight = trees.settle(feature, cut, left, np.ascontiguousarray(columns.T)), rng.integers(-9, 9, 500).astype(float)
    assert (trees.place(columns, feature, cut, left, np.arange(7)) == at).all()
    where = np.array([3, 3, 0, 1, 3, 2, 3])[at]  # place 3: not open
    n, s = np.zeros((3, layout.total)), np.zeros((3, layout.total))
    trees.Counter(columns, layout).add((n, s), where, 3, weight)
    for node in range(3):
        for f in range(4):
            for code in range(layout.bins[f]):
                hit = (where == node) & (columns[f] == code)
                assert (n[node, layout.start[f] + code], s[node, layout.start[f] + code]) == (hit.sum(), weight[hit].sum())
