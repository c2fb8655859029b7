"""Registered queries: CSV round trip, missing-token normalisation, leaderboard export, saved-model scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.catalog import register
from tessera.plans.fixtures import table
from tessera.session import scratch_path
from tessera.sources import sinks
from tessera.sources.readers import read_csv


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv_roundtrip")
    table(spark, sf, "customer").write.mode("overwrite").option("header", True).csv(path)
    return read_csv(spark, path)


def orders_with_tokens(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    s = lambda c: F.col(c).cast("string")
    return o.select(
        s("o_orderkey").alias("o_orderkey"),
        F.when(k % 13 == 0, F.lit("null")).otherwise(s("o_custkey")).alias("o_custkey"),
        F.when(k % 5 == 0, F.lit("N/A")).otherwise(s("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 == 0, F.lit("NA")).when(k % 17 == 0, F.lit("NaN")).otherwise(s("o_totalprice"))
        .alias("o_totalprice"),
        s("o_orderdate").alias("o_orderdate"),
        F.when(k % 11 == 0, F.lit("")).otherwise(s("o_orderpriority")).alias("o_orderpriority"),
    )


@register("normalize_missing")
def q_normalize_missing(spark, sf):
    path = scratch_path(spark, "normalize_missing")
    orders_with_tokens(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    return read_csv(spark, path)


@register("leaderboard_export")
def q_leaderboard_export(spark, sf):
    from tessera.plans.catalog_models import _run

    res = _run(spark, sf, "regression")
    path = sinks.export_leaderboard(res.leaderboard, res.best_model_name, res.family,
                                    scratch_path(spark, "leaderboard_export"))
    back = spark.read.option("header", True).csv(path)
    return back.drop("Training_Time")


@register("score_saved_model")
def q_score_saved_model(spark, sf):
    from tessera.plans.catalog_models import _run

    res = _run(spark, sf, "regression")
    path = sinks.save_package(res, scratch_path(spark, "model_package"))
    pkg = sinks.load_package(spark, path)
    return pkg.score(table(spark, sf, "customer"), keep=["c_custkey"])


@register("score_linear_package")
def q_score_linear_package(spark, sf):
    """A linear model with imputed, scaled and one-hot columns is saved, loaded and applied to unlabelled rows."""
    from tessera.operators.models import TrainConfig, compare_models
    from tessera.plans.fixtures import lineitem_gaps

    df = lineitem_gaps(spark, sf)
    res = compare_models(df.select("l_quantity", "l_linestatus", "l_extendedprice"), TrainConfig("l_extendedprice", "regression", models=("LinearRegression",)))
    pkg = sinks.load_package(spark, sinks.save_package(res, scratch_path(spark, "linear_package")))
    out = pkg.score(df.drop("l_extendedprice"), keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.round("prediction", 1).alias("prediction"))


@register("rows_as_json")
def q_rows_as_json(spark, sf):
    from tessera.functions.scalars import json_safe_row
    from tessera.plans.fixtures import lineitem_gaps

    df = lineitem_gaps(spark, sf)
    return df.select("l_orderkey", "l_linenumber", json_safe_row(df.schema.fields).alias("json"))
