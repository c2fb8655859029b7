"""Held-out metrics, best-model choice and display scores — all DataFrame aggregates.

Classification metrics come from the confusion counts ``groupBy(label,
prediction)`` (k² rows, whatever the data size); weighted precision /
recall / F1 use support weights with zero division → 0, as the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEADERBOARD_SCHEMA = ("model string, model_idx int, accuracy double, precision double, recall double, f1 double, "
                      "mse double, r2 double, training_time double")


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: ``accuracy, precision, recall, f1`` (weighted by support, zero division → 0)."""
    conf = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    true_side = conf.groupBy(F.col("y").alias("c")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    pred_side = conf.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    per = true_side.join(pred_side, "c", "full_outer").select(
        "c", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumn("prec", prec).withColumn("rec", rec)
    f1 = F.when(F.col("prec") + F.col("rec") > 0,
                2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0)
    per = per.withColumn("f1c", f1)
    total = F.sum("support")
    return per.agg(
        F.try_divide(F.sum("tp"), total).cast("double").alias("accuracy"),
        F.try_divide(F.sum(F.col("support") * F.col("prec")), total).cast("double").alias("precision"),
        F.try_divide(F.sum(F.col("support") * F.col("rec")), total).cast("double").alias("recall"),
        F.try_divide(F.sum(F.col("support") * F.col("f1c")), total).cast("double").alias("f1"),
    )


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: ``mse, r2``; a constant target gives r2 = 1 for a perfect fit, else 0."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    a = pred.agg(F.count(F.lit(1)).alias("n"), F.avg((y - p) * (y - p)).alias("mse"),
                 F.sum((y - p) * (y - p)).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"))
    r2 = (F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("sse") / F.col("sst")))
    return a.select(F.col("mse").cast("double").alias("mse"), r2.cast("double").alias("r2"))


def best_model(board: DataFrame, family: str) -> DataFrame:
    """Arg-max by accuracy (classification) or r2 (regression); missing → −∞; tie → first in registry order."""
    score = "accuracy" if family == "classification" else "r2"
    key = F.coalesce(F.col(score), F.lit(float("-inf")))
    return board.orderBy(key.desc(), F.col("model_idx").asc()).limit(1)


def display_score(board: DataFrame) -> DataFrame:
    """Score shown per model: accuracy if non-zero, else r2 if non-zero, else the first metric (time), else 0."""
    s = F.coalesce(F.nullif(F.col("accuracy"), F.lit(0.0)), F.nullif(F.col("r2"), F.lit(0.0)),
                   F.col("training_time"), F.lit(0.0))
    return board.select("model", "model_idx", s.cast("double").alias("display_score"))


def score_text(board: DataFrame, family: str) -> DataFrame:
    """Primary score to 3 places, 'N/A' when absent."""
    score = "accuracy" if family == "classification" else "r2"
    return board.select("model", "model_idx", F.coalesce(F.format_number(F.col(score), 3), F.lit("N/A")).alias(
        "score_text"))
