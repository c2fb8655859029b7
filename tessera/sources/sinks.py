"""Sinks: leaderboard CSV, model package (features + fitted MLlib model), run-result store."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import qcol

from tessera.operators.artifact import pipeline_model
from tessera.operators.features import FeatureSpec, check_columns

# fixed values: export header metric keys in the order the metrics record holds them
EXPORT_KEYS = {
    "classification": (("Training_Time", "training_time"), ("Accuracy", "accuracy"), ("Precision", "precision"),
                       ("Recall", "recall"), ("F1", "f1")),
    "regression": (("Training_Time", "training_time"), ("MSE", "mse"), ("R2", "r2")),
}

USAGE = """Model package
=============
pipeline/    preprocessing and best model as one PipelineModel
tables/      vocabularies too large for a stage (read by the pipeline where they are)
spec/        columns and statistics of the preprocessing (JSON)
leaderboard/ all compared models

Usage (Spark alone, without this library unless the best model is a kernel one):
    from pyspark.ml import PipelineModel
    predictions = PipelineModel.load("<this folder>/pipeline").transform(new_df)
"""


def leaderboard_table(board: DataFrame, best_name: str, family: str) -> DataFrame:
    """Export layout: ``Model, Best_Model (Yes/No), <metric keys>``; missing metric → empty text."""
    cols = [F.col("model").alias("Model"),
            F.when(F.col("model") == F.lit(best_name), "Yes").otherwise("No").alias("Best_Model")]
    for header, c in EXPORT_KEYS[family]:
        cols.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(header))
    return board.orderBy("model_idx").select(cols)


def export_leaderboard(board: DataFrame, best_name: str, family: str, path: str) -> str:
    """One CSV file with a header (≤ one row per model, so one partition is right)."""
    (leaderboard_table(board, best_name, family).coalesce(1).write.mode("overwrite")
     .option("header", True).option("emptyValue", "").csv(path))
    return path


class ModelPackage:
    """A loaded package: the pipeline, and the columns that it was fitted on."""

    def __init__(self, pipeline: PipelineModel, spec: FeatureSpec, best_name: str, family: str):
        self.pipeline, self.spec, self.best_name, self.family = pipeline, spec, best_name, family

    def score(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` and the predictions for new rows; a text target is decoded back to its class names."""
        check_columns(self.spec, df)
        wanted = list(dict.fromkeys([*(keep or []), *self.spec.used_columns()]))
        pred = self.pipeline.transform(df.select(*[qcol(c) for c in wanted]))
        decoded = self.family == "classification" and self.spec.target_kind == "text"
        return pred.select(*[qcol(k) for k in (keep or [])], "prediction", *["predicted_label"] * decoded)


def save_package(result, path: str, board: DataFrame | None = None) -> str:
    """Best model + preprocessing as one ``PipelineModel`` (replaces the zip of pickles)."""
    spark = result.leaderboard.sparkSession
    model = result.models[result.best_model_name]
    pipeline_model(result.features, model, result.family, f"{path}/tables").write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame([(result.features.spec.to_json(),)], "spec string").coalesce(1).write.mode("overwrite").json(f"{path}/spec")
    meta = {"best_model": result.best_model_name, "family": result.family, "model_class": type(model).__name__, "usage": USAGE}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    (board if board is not None else result.leaderboard).write.mode("overwrite").parquet(f"{path}/leaderboard")
    return path


def load_package(spark: SparkSession, path: str) -> ModelPackage:
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    spec = FeatureSpec.from_json(spark.read.json(f"{path}/spec").first()["spec"])
    return ModelPackage(PipelineModel.load(f"{path}/pipeline"), spec, meta["best_model"], meta["family"])


class RunStore:
    """Results of runs kept by ``run_id``: a table a result name, a partition a run, and a manifest of what each run has put.

    Everything goes through DataFrames: a run's partition is overwritten alone (dynamic
    partition overwrite); the manifest has a row a run and name, which says whether it
    is there, the kinds of its columns and its rows.  Clearing a run empties its partitions.
    """

    MANIFEST = "run_id string, name string, rows long, columns string, present boolean"

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _overwrite(self, df: DataFrame, path: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def _note(self, rows: list[tuple]) -> None:
        self._overwrite(self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1), f"{self.base}/manifest", "run_id", "name")

    def manifest(self) -> DataFrame:
        """``(run_id, name, rows, columns)`` of everything that is there."""
        schema = T.StructType.fromDDL(self.MANIFEST)
        empty = self.spark.createDataFrame([], schema)
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.base}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = empty
        return found.where("present").select("run_id", "name", "rows", "columns")

    def put(self, run_id: str, name: str, df: DataFrame) -> None:
        path = f"{self.base}/results/{name}"
        self._overwrite(df.withColumn("run_id", F.lit(run_id)), path, "run_id")
        kept = self.spark.read.schema(_with_run(df.schema)).parquet(path).where(F.col("run_id") == run_id)
        self._note([(run_id, name, kept.count(), df.schema.json(), True)])

    def get(self, run_id: str, name: str) -> DataFrame:
        """What the run has put under the name; an empty frame if nothing."""
        noted = self.manifest().where((F.col("run_id") == run_id) & (F.col("name") == name)).first()
        if noted is None:
            other = self.manifest().where(F.col("name") == name).first()
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(other["columns"])) if other else T.StructType())
        schema = T.StructType.fromJson(json.loads(noted["columns"]))
        return self.spark.read.schema(_with_run(schema)).parquet(f"{self.base}/results/{name}").where(F.col("run_id") == run_id).drop("run_id")

    def clear(self, run_id: str, name: str | None = None) -> None:
        for noted in self.manifest().where(F.col("run_id") == run_id).collect():  # one row a result of the run
            if name in (None, noted["name"]):
                schema = T.StructType.fromJson(json.loads(noted["columns"]))
                # an overwrite without rows touches no partition: one row of nulls takes the place of the run's
                gone = self.spark.createDataFrame([(None,) * len(schema) + (run_id,)], _with_run(schema))
                self._overwrite(gone.coalesce(1), f"{self.base}/results/{noted['name']}", "run_id")
                self._note([(run_id, noted["name"], 0, noted["columns"], False)])

    def names(self) -> list[str]:
        return sorted(r["name"] for r in self.manifest().select("name").distinct().collect())

    def runs(self) -> list[str]:
        return sorted(r["run_id"] for r in self.manifest().select("run_id").distinct().collect())


def _with_run(schema: T.StructType) -> T.StructType:
    nullable = [T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields]
    return T.StructType([*nullable, T.StructField("run_id", T.StringType())])
