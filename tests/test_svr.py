"""ε-insensitive regression: optimality by the duality gap and against a plain solver; interruption; run store."""

import time

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import svr
from tessera.operators.kernels import rff_weights
from tessera.operators.models import TrainConfig, compare_models
from tessera.sources import sinks


def plain_solver(z, y, c, eps, rounds=6000):
    """Sequential pair updates of the dual (Σα = 0, |α| ≤ C) on one machine: the exact problem, by another way."""
    k, a = z @ z.T, np.zeros(len(y))
    f = np.zeros(len(y))  # K a
    for _ in range(rounds):
        # the steepest feasible pair: raise a_i, lower a_j
        up = np.where(a < c - 1e-12, y - f - eps * np.where(a < -1e-12, -1, 1), -np.inf)
        down = np.where(a > -c + 1e-12, y - f - eps * np.where(a > 1e-12, 1, -1), np.inf)
        i, j = int(np.argmax(up)), int(np.argmin(down))
        if up[i] - down[j] < 1e-7:
            break
        bend = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        most = min(c - a[i] if a[i] >= 0 else -a[i], a[j] + c if a[j] <= 0 else a[j])
        step = min((up[i] - down[j]) / bend, most)
        a[i] += step
        a[j] -= step
        f += step * (k[:, i] - k[:, j])
    w = z.T @ a
    return w, (up[i] + down[j]) / 2


def _data(n=500, seed=3, scale=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, scale * (np.sin(x[:, 0]) + 0.5 * x[:, 1] + 0.1 * rng.normal(size=n))


def test_agrees_with_a_plain_solver(spark):
    x, y = _data()
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["f", "y"]).repartition(5)
    fit = svr.fit_svr(df, "f", "y", 3, 32, 0.3, 42)
    z = svr.random_features(x, *rff_weights(3, 32, 0.3, 42))
    w, b = plain_solver(z, y, 1.0, 0.1)
    exact = 0.5 * w @ w + np.maximum(np.abs(y - z @ w - b) - 0.1, 0).sum()
    assert fit.gap <= 1e-4 * fit.objective and abs(fit.objective - exact) <= 1e-3 * exact
    assert np.abs((z @ fit.weights + fit.intercept) - (z @ w + b)).max() <= 1e-2
    assert np.abs((z @ fit.weights + fit.intercept) - (z @ w + b)).mean() <= 1e-3


def test_large_targets_and_few_rows(spark):
    """Targets far beyond C: every row at its bound, the intercept near the middle; one row; equal targets."""
    x, y = _data(200, 4, 5000.0)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["f", "y"]).repartition(3)
    fit = svr.fit_svr(df, "f", "y", 3, 16, 0.3, 42)
    z = svr.random_features(x, *rff_weights(3, 16, 0.3, 42))
    assert abs(fit.gap) <= 1e-4 * fit.objective
    left = y - z @ fit.weights - fit.intercept
    assert abs(int((left > 0).sum()) - int((left < 0).sum())) <= 20
    one = spark.createDataFrame([(Vectors.dense([1.0, 2.0, 3.0]), 7.0)], ["f", "y"])
    assert abs(svr.fit_svr(one, "f", "y", 3, 8, 0.3, 42).intercept - 7.0) <= 0.11
    same = df.withColumn("y", F.lit(3.0))
    assert svr.fit_svr(same, "f", "y", 3, 8, 0.3, 42).objective <= 1e-6


def test_registry_package_and_huber(spark, tmp_path):
    i = F.col("id")
    df = spark.range(300).select(i, (i % 10).cast("double").alias("x"), ((i % 10) * 0.5 + (i % 3) * 0.01).alias("y"))
    for loss in ("epsilon", "huber"):
        res = compare_models(df, TrainConfig("y", "regression", split_keys=("id",), models=("SVR_RFF",), rff_dim=64, svr_loss=loss))
        assert not res.skipped and res.best_metrics["r2"] > 0.8
        pkg = sinks.load_package(spark, sinks.save_package(res, str(tmp_path / loss)))
        want = {r.id: r.prediction for r in res.models["SVR_RFF"].transform(res.features.transform(df, keep=["id"])).collect()}
        got = {r.id: r.prediction for r in pkg.score(df, keep=["id"]).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_slow_fit_is_cancelled(spark, monkeypatch):
    from tessera.operators import models as m

    class Slow:
        def fit(self, train):
            while True:  # a job after the other, each of some seconds
                train.sparkSession.range(0, 8, 1, 8).mapInPandas(lambda it: (time.sleep(4) or b for b in it), "id long").count()

    registry = {"regression": [("Slow", lambda ctx: Slow()), *[x for x in m.REGISTRY["regression"] if x[0] == "LinearRegression"]]}
    monkeypatch.setattr(m, "REGISTRY", registry)
    df = spark.range(100).select(F.col("id"), (F.col("id") * 2.0).alias("y"))
    began = time.time()
    res = compare_models(df, TrainConfig("y", "regression", split_keys=("id",), timeout_seconds=15.0, interrupt=True))
    assert "FitInterrupted" in res.skipped["Slow"] and list(res.models) == ["LinearRegression"] and time.time() - began < 90
    tracker = spark.sparkContext.statusTracker()
    until = time.time() + 20
    while tracker.getActiveJobsIds() and time.time() < until:
        time.sleep(0.5)
    assert not tracker.getActiveJobsIds()


def test_run_store_lists_and_clears(spark, tmp_path):
    store = sinks.RunStore(spark, str(tmp_path / "runs"))
    assert store.names() == [] and store.runs() == [] and store.manifest().count() == 0
    board = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "m string, s double")
    store.put("r1", "board", board)
    store.put("r1", "other", spark.range(3))
    store.put("r2", "board", board.limit(1))
    store.put("r1", "board", board.limit(1))  # again: replaced
    assert store.names() == ["board", "other"] and store.runs() == ["r1", "r2"]
    assert {(r.run_id, r["name"]): r["rows"] for r in store.manifest().collect()} == {("r1", "board"): 1, ("r1", "other"): 3, ("r2", "board"): 1}
    assert store.get("r1", "board").columns == ["m", "s"] and store.get("r1", "board").count() == 1
    store.clear("r1", "other")
    assert store.names() == ["board"] and store.get("r1", "other").count() == 0
    store.clear("r1")
    assert store.runs() == ["r2"] and store.get("r1", "board").count() == 0 and store.get("r1", "board").columns == ["m", "s"]
    assert store.get("r2", "board").count() == 1 and store.get("r9", "nothing").count() == 0
    store.put("r1", "board", board)
    assert store.get("r1", "board").count() == 2
