"""Registered queries: target guess, problem types, target analysis, config validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import target
from tessera.plans.catalog import register
from tessera.plans.fixtures import TABLES, lineitem_gaps, table

VALIDATION_TYPES = ("classification", "regression", "binary", "clustering")
VALIDATION_RATIOS = ("0.8", "1.0", "abc")


def _union(parts):
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


@register("detect_target")
def q_detect_target(spark, sf):
    found = target.detect_targets({t: table(spark, sf, t) for t in TABLES})
    return spark.createDataFrame(found, "table_name string, target string, problem_type string, unique_values long")


@register("problem_type")
def q_problem_type(spark, sf):
    a = target.problem_types(lineitem_gaps(spark, sf)).select(F.lit("lineitem_gaps").alias("table_name"), "*")
    b = target.problem_types(table(spark, sf, "orders")).select(F.lit("orders").alias("table_name"), "*")
    return a.unionByName(b)


@register("analyze_target")
def q_analyze_target(spark, sf):
    df = lineitem_gaps(spark, sf)
    return _union(target.analyze_target(df, c, ["l_orderkey", "l_linenumber"]) for c in df.columns)


@register("quick_type")
def q_quick_type(spark, sf):
    return _union(target.quick_type(table(spark, sf, t), [key]).select(F.lit(t).alias("table_name"), "*")
                  for t, key in (("orders", "o_orderkey"), ("part", "p_partkey"), ("customer", "c_custkey")))


@register("validate_config")
def q_validate_config(spark, sf):
    parts = []
    for t in ("region", "supplier", "lineitem_gaps"):
        df = lineitem_gaps(spark, sf) if t == "lineitem_gaps" else table(spark, sf, t)
        grid = [(c, p, r) for c in df.columns + ["missing_col"] for p in VALIDATION_TYPES for r in VALIDATION_RATIOS]
        parts.append(target.validate_configs(df, grid).select(F.lit(t).alias("table_name"), "*"))
    return _union(parts)


SPLIT_RATIOS = (0.29, 0.57, 0.58, 0.8)


@register("split_summary")
def q_split_summary(spark, sf):
    """Rows on each side of the md5 split for several ratios, with the displayed percentages."""
    from tessera.functions.scalars import split_percentages
    from tessera.operators.sampling import split_flag

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    parts = []
    for r in SPLIT_RATIOS:
        tr, te = split_percentages(F.lit(r))
        parts.append(li.groupBy(split_flag(["l_orderkey", "l_linenumber"], r, 42).alias("is_train")).agg(
            F.count(F.lit(1)).alias("rows")).select(F.lit(r).alias("ratio"), "is_train", "rows",
                                                     tr.alias("train_pct"), te.alias("test_pct")))
    return _union(parts)
