"""Registered queries: imputing, scaling, one-hot, ordinal and target codes, feature matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import features as fx
from tessera.operators import sampling
from tessera.plans.catalog import register
from tessera.plans.fixtures import lineitem_gaps, part_gaps, table


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


@register("impute_mean")
def q_impute_mean(spark, sf):
    df = fx.impute_mean(lineitem_gaps(spark, sf), ["l_quantity", "l_discount"])
    return df.select("l_orderkey", "l_linenumber", _r6("l_quantity"), _r6("l_discount"))


@register("standard_scale")
def q_standard_scale(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = fx.standard_scale(lineitem_gaps(spark, sf), cols)
    return df.select("l_orderkey", "l_linenumber", *[_r6(c) for c in cols])


@register("impute_mode")
def q_impute_mode(spark, sf):
    li = fx.impute_mode(lineitem_gaps(spark, sf), ["l_returnflag"]).select("l_orderkey", "l_linenumber",
                                                                          "l_returnflag")
    p = fx.impute_mode(part_gaps(spark, sf), ["p_brand", "p_type"]).select("p_partkey", "p_brand", "p_type")
    return li.select(F.lit("lineitem_gaps").alias("source"), F.col("l_orderkey").alias("key"),
                     F.col("l_linenumber").cast("long").alias("sub"), F.col("l_returnflag").alias("value")).unionByName(
        p.select(F.lit("part_gaps.p_brand").alias("source"), F.col("p_partkey").alias("key"),
                 F.lit(0).cast("long").alias("sub"), F.col("p_brand").alias("value"))).unionByName(
        p.select(F.lit("part_gaps.p_type").alias("source"), F.col("p_partkey").alias("key"),
                 F.lit(0).cast("long").alias("sub"), F.col("p_type").alias("value")))


def _part_model(spark, sf):
    df = part_gaps(spark, sf)
    return df, fx.fit_features(df, "p_retailprice")


@register("one_hot")
def q_one_hot(spark, sf):
    df, model = _part_model(spark, sf)
    names = [n for n in model.feature_names() if n.startswith("cat__")]
    enc = model.encode(df, keep=["p_partkey"])
    return fx.to_long(enc, ["p_partkey"], names)


@register("ordinal_encode")
def q_ordinal_encode(spark, sf):
    p = table(spark, sf, "part")
    c = table(spark, sf, "customer")
    pv, ps = fx.vocabulary(p, "p_name")
    a = fx.apply_codes(p, "p_name", pv, "code", ps).select(
        F.lit("part.p_name").alias("source"), F.col("p_partkey").alias("key"), "code")
    cv, cs = fx.vocabulary(c, "c_name")
    b = fx.apply_codes(c, "c_name", cv, "code", cs).select(
        F.lit("customer.c_name").alias("source"), F.col("c_custkey").alias("key"), "code")
    return a.unionByName(b)


@register("encode_target")
def q_encode_target(spark, sf):
    df = part_gaps(spark, sf)
    return fx.target_codes(df, "p_type").select("p_partkey", F.col("label").alias("label"))


@register("simple_features")
def q_simple_features(spark, sf):
    out = fx.simple_features(part_gaps(spark, sf))
    return out.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", _r6("p_retailprice"))


def _customer_long(model, df):
    enc = model.encode(df, keep=["c_custkey"])
    long = fx.to_long(enc, ["c_custkey"], model.feature_names())
    return long.select("c_custkey", "feature", _r6("value"))


@register("build_features")
def q_build_features(spark, sf):
    df = table(spark, sf, "customer")
    return _customer_long(fx.fit_features(df, "c_acctbal"), df)


@register("apply_features")
def q_apply_features(spark, sf):
    df = table(spark, sf, "customer")
    train, _ = sampling.train_test_split(df, ["c_custkey"], 0.8, 42)
    model = fx.fit_features(df, "c_acctbal", fit_rows=train)
    return _customer_long(model, df)


@register("feature_names")
def q_feature_names(spark, sf):
    rows = []
    for t, tgt, df in (("customer", "c_acctbal", table(spark, sf, "customer")),
                       ("part_gaps", "p_retailprice", part_gaps(spark, sf)),
                       ("lineitem_gaps", "l_extendedprice", lineitem_gaps(spark, sf))):
        names = fx.fit_features(df, tgt).feature_names()
        rows += [(t, i, n) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "table_name string, position int, feature string")
