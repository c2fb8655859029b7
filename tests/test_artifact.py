"""One PipelineModel: preprocessing and model, reloadable by Spark alone."""

import datetime as dt
import subprocess
import sys

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tessera.operators import artifact
from tessera.operators.models import TrainConfig, compare_models
from tessera.sources import sinks

ODD = "it's `a.b` \\ \"é\n"


def _table(spark, n=300):
    i = F.col("id")
    return spark.range(n).select(
        i, (i % 10).cast("double").alias("x.1"), F.when(i % 4 != 0, (i % 7).cast("float")).alias("f`t"),
        F.when(i % 6 == 0, F.lit(float("nan"))).otherwise(-(i % 3).cast("double")).alias("n"),
        F.make_dt_interval(F.lit(0), F.lit(0), i.cast("int")).alias("span"), (i % 5).cast("decimal(9,2)").alias("dec"),
        F.concat(F.lit(ODD), (i % 12).cast("string")).alias("few"), F.when(i % 9 != 0, F.concat(F.lit("v'"), (i % 80).cast("string"))).alias("many"),
        F.lit(None).cast("string").alias("empty"), (i % 10 >= 5).alias("flag"),
        F.when(i % 10 >= 5, "hi'").otherwise("lo").alias("cls"), ((i % 10) * 3.0 + (i % 3)).alias("y"))


def _new_rows(spark):
    df = _table(spark, 40)
    odd = df.limit(1).withColumn("few", F.lit("unseen")).withColumn("many", F.lit("unseen too")).withColumn("id", F.lit(1000).cast("long"))
    none = df.limit(1).select(*[F.lit(None).cast(t).alias(c) if c != "id" else F.lit(1001).cast("long").alias(c) for c, t in df.dtypes])
    return df.unionByName(odd).unionByName(none)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("labels", [artifact.LABELS, 3])
@pytest.mark.parametrize("name", ["LogisticRegression", "DecisionTree", "SVC_RFF"])
def test_package_equals_features_and_model(spark, tmp_path, monkeypatch, name, labels):
    """Row for row what the fitted features and the model give, with small vocabularies in stages or all joined."""
    monkeypatch.setattr(artifact, "LABELS", labels)
    res = compare_models(_table(spark).drop("y"), TrainConfig("cls", "binary", split_keys=("id",), models=(name,), rff_dim=16))
    assert "many" in res.features.spec.ordinal and not res.skipped
    pkg = sinks.load_package(spark, sinks.save_package(res, str(tmp_path / "p")))
    new = _new_rows(spark)
    want = res.models[name].transform(res.features.transform(new.drop("cls"), keep=["id"])).select("id", "prediction")
    got = pkg.score(new.drop("cls"), keep=["id"])
    assert _rows(got.select("id", "prediction")) == _rows(want)
    assert {(r.prediction, r.predicted_label) for r in got.collect()} <= {(0.0, "hi'"), (1.0, "lo")}


def test_regression_with_input_columns_named_like_ours(spark, tmp_path):
    df = _table(spark).drop("cls").withColumn("features", F.col("id") % 2).withColumn("row", F.lit("r")).withColumn("f0", F.col("id") % 3).withColumn("s0", F.lit("s"))
    res = compare_models(df, TrainConfig("y", "regression", split_keys=("id",), models=("LinearRegression",)))
    pkg = sinks.load_package(spark, sinks.save_package(res, str(tmp_path / "p")))
    want = res.models["LinearRegression"].transform(res.features.transform(df, keep=["id"])).select("id", "prediction")
    assert _rows(pkg.score(df, keep=["id"])) == _rows(want)
    whole = pkg.pipeline.transform(df)
    assert whole.columns == [*df.columns, "prediction"]
    with pytest.raises(ValueError, match="Missing feature columns: dec"):
        pkg.score(df.drop("dec"))
    with pytest.raises(ValueError, match="another type"):
        pkg.score(df.withColumn("dec", F.lit("x")))


def test_every_stage_is_sparks_own(spark, tmp_path):
    res = compare_models(_table(spark).drop("y"), TrainConfig("cls", "binary", split_keys=("id",), models=("DecisionTree",)))
    path = sinks.save_package(res, str(tmp_path / "p"))
    classes = {r["class"] for r in spark.read.json(f"{path}/pipeline/stages/*/metadata").collect()}
    assert classes and all(c.startswith("org.apache.spark.ml.") for c in classes)


def test_a_fresh_session_without_this_library(spark, tmp_path):
    res = compare_models(_table(spark).drop("cls"), TrainConfig("y", "regression", split_keys=("id",), models=("LinearRegression",)))
    path, new = sinks.save_package(res, str(tmp_path / "p")), _new_rows(spark).drop("y", "cls")
    new.write.parquet(str(tmp_path / "new"))
    code = ("from pyspark.sql import SparkSession; from pyspark.ml import PipelineModel\n"
            "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            f"PipelineModel.load('{path}/pipeline').transform(spark.read.parquet('{tmp_path}/new')).select('id', 'prediction').write.parquet('{tmp_path}/out')\n"
            "import sys; assert not any(m.startswith('tessera') for m in sys.modules)\n")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=180, cwd=str(tmp_path))
    want = PipelineModel.load(f"{path}/pipeline").transform(new).select("id", "prediction")
    assert _rows(spark.read.parquet(str(tmp_path / "out"))) == _rows(want)


def test_literals(spark):
    for text in (ODD, "", "'", "\\u0041", "漢\t"):
        assert spark.sql(f"SELECT {artifact.text_sql(text)}").first()[0] == text
    for value in (0.1, -1e-300, 1 / 3, 5e-324, 1.7976931348623157e308):
        assert spark.sql(f"SELECT {artifact.double_sql(value)}").first()[0] == value
    day = spark.createDataFrame([(dt.timedelta(days=1, microseconds=5),)], "`a``b` interval day to second")
    assert day.selectExpr(f"{artifact.number_sql('a`b', 'interval day to second')} AS s").first().s == 86400.000005
