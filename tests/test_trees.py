import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from tessera.operators import models, trees
from tessera.operators.models import TrainConfig, compare_models
from tessera.sources import sinks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 20, 3000), rng.integers(0, 12, 3000), rng.integers(0, 2, 3000), rng.integers(0, 30, 3000)]).astype(float)
    score = x[:, 0] * 0.37 + np.sin(x[:, 1]) * 3 + x[:, 2] * x[:, 3] * 0.21
    y = score + rng.normal(0, 1.3, 3000)
    k = np.digitize(y, np.quantile(y, [0.3, 0.7]))
    data = [(i, *map(float, r), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, k))]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, d double, y double, k double")
    return df.select("id", array_to_vector(F.array("a", "b", "c", "d")).alias("features"), "y", "k").repartition(3, "id").sortWithinPartitions("id").persist()


def predicted(model, df):
    return np.array([r["prediction"] for r in model.transform(df).select("id", "prediction").orderBy("id").collect()])


def labelled(df, column):
    return df.withColumn("label", F.col(column))


@pytest.mark.parametrize("shard", [1 << 17, 300])  # one task grows the tree; histograms split it first
def test_tree_equals_mllib(spark, rows, shard, monkeypatch):
    monkeypatch.setattr(trees, "SHARD_ROWS", shard)
    df = labelled(rows, "y")
    ours = trees.fit_forest(df, 4, 3000, 0, 1, 6, 32, 1, False, 4)
    theirs = DecisionTreeRegressor(maxDepth=6, seed=1).fit(df)
    assert np.allclose(predicted(ours, df), predicted(theirs, df), atol=1e-6)
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-6)
    df = labelled(rows, "k")
    ours, theirs = trees.fit_forest(df, 4, 3000, 3, 1, 6, 32, 1, False, 4), DecisionTreeClassifier(maxDepth=6, seed=1).fit(df)
    assert (predicted(ours, df) == predicted(theirs, df)).mean() > 0.995  # equal counts in a leaf may fall either way


def test_boosting_equals_mllib(spark, rows, monkeypatch):
    monkeypatch.setattr(trees, "KEEP", 3)
    df = labelled(rows, "y")
    ours, theirs = trees.fit_boosted(df, 4, 3000, 0, 7, 3, 32, 1), GBTRegressor(maxIter=7, maxDepth=3, stepSize=0.1, seed=1).fit(df)
    assert np.allclose(predicted(ours, df), predicted(theirs, df), atol=1e-5)
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-5)
    gbt = GBTClassifier(maxIter=7, maxDepth=3, stepSize=0.1, seed=1)
    df = labelled(rows, "k").withColumn("label", (F.col("k") > 0).cast("double"))
    assert (predicted(trees.fit_boosted(df, 4, 3000, 2, 7, 3, 32, 1), df) == predicted(gbt.fit(df), df)).mean() > 0.999
    df = labelled(rows, "k")
    assert (predicted(trees.fit_boosted(df, 4, 3000, 3, 7, 3, 32, 1), df) == predicted(OneVsRest(classifier=gbt).fit(df), df)).mean() > 0.999


def test_forest_grows_to_the_end_whatever_the_shards(spark, rows, monkeypatch):
    """Every row of a deep forest's own table is nearly met, and no shard is larger than allowed."""
    df = labelled(rows, "y")
    found = []
    for shard in (1 << 17, 400):
        monkeypatch.setattr(trees, "SHARD_ROWS", shard)
        monkeypatch.setattr(trees, "BATCH_CELLS", 3000 * 7)  # three batches of trees
        model = trees.fit_forest(df, 4, 3000, 0, 20, 30, 32, 5, True, 4)
        assert model.trees.groupBy("tree").count().count() == 20
        found.append(predicted(model, df))
    assert np.allclose(found[0], found[1], atol=1e-6)  # all features are tried, so shards change nothing
    y = np.array([r["y"] for r in rows.select("id", "y").orderBy("id").collect()])
    assert np.corrcoef(found[0], y)[0, 1] > 0.93


def test_pure_and_constant_tables(spark):
    df = spark.range(200).select("id", array_to_vector(F.array((F.col("id") % 3).cast("double"), F.lit(1.0))).alias("features"), F.lit(7.0).alias("label")).coalesce(1)
    assert set(predicted(trees.fit_forest(df, 2, 200, 0, 3, 30, 32, 1, True, 2), df)) == {7.0}
    assert set(predicted(trees.fit_boosted(df, 2, 200, 0, 3, 3, 32, 1), df)) == {7.0}
    ones = df.withColumn("label", F.lit(1.0))
    assert set(predicted(trees.fit_forest(ones, 2, 200, 2, 3, 30, 32, 1, True, 1), ones)) == {1.0}


@pytest.mark.parametrize("name", ["RandomForest", "DecisionTree", "GradientBoosting"])
def test_large_tables_are_compared_and_packaged(spark, tmp_path, monkeypatch, name):
    """Beyond MLLIB_ROWS no estimator of MLlib is called, and the best model still goes into a package."""
    monkeypatch.setattr(models, "MLLIB_ROWS", 100)
    df = spark.range(600).select("id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("t"), ((F.col("id") % 10) * 3.0 + F.when(F.col("id") % 3 == 0, 5).otherwise(0)).alias("y"))
    res = compare_models(df, TrainConfig("y", "regression", split_keys=("id",), models=(name,), num_trees=5, boost_iters=30))
    assert not res.skipped and type(res.models[name]).__module__ == "tessera.operators.trees"
    assert res.best_metrics["r2"] > 0.9 and res.importance.count() == len(res.feature_names)
    pkg = sinks.load_package(spark, sinks.save_package(res, str(tmp_path / "pkg")))
    scored = {r["id"]: r["prediction"] for r in pkg.score(df.drop("y"), keep=["id"]).collect()}
    direct = {r["id"]: r["prediction"] for r in res.models[name].transform(res.features.transform(df, keep=["id"])).select("id", "prediction").collect()}
    assert scored.keys() == direct.keys() and len(scored) == 600
    assert all(abs(scored[i] - direct[i]) < 1e-9 for i in scored)


def test_large_classification_finds_the_rule(spark, monkeypatch):
    monkeypatch.setattr(models, "MLLIB_ROWS", 100)
    df = spark.range(900).select("id", (F.col("id") % 9).cast("double").alias("x"), F.rand(4).alias("noise"), F.concat(F.lit("c"), ((F.col("id") % 9) / 3).cast("int").cast("string")).alias("label_text"))
    res = compare_models(df, TrainConfig("label_text", "multiclass", split_keys=("id",), models=("RandomForest", "GradientBoosting", "DecisionTree"), num_trees=9, boost_iters=5))
    assert not res.skipped
    assert all(r["accuracy"] > 0.95 for r in res.leaderboard.collect())
    assert {type(m).__module__ for m in res.models.values()} == {"tessera.operators.trees"}
