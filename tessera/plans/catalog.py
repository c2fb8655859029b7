"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the driver tables.

Every query reads whole tables (or frames Spark derives from them); column
names match the SQL oracle in ``tessera.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import escape_html
from tessera.operators import correlation, profile, sampling
from tessera.plans.fixtures import TABLES, lineitem_gaps, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


# ---------------------------------------------------------------- step 1: schema + flagship
@register("column_profile")
def q_column_profile(spark, sf):
    return profile.column_profile(lineitem_gaps(spark, sf))


@register("column_types")
def q_column_types(spark, sf):
    out = None
    for t in TABLES:
        part = profile.column_types(table(spark, sf, t)).select(F.lit(t).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@register("column_type_distribution")
def q_column_type_distribution(spark, sf):
    out = None
    for t in TABLES:
        part = profile.column_type_distribution(table(spark, sf, t)).select(F.lit(t).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- step 2: profile
@register("table_profile")
def q_table_profile(spark, sf):
    return profile.table_profile(lineitem_gaps(spark, sf))


@register("missing_by_column")
def q_missing_by_column(spark, sf):
    return profile.missing_by_column(lineitem_gaps(spark, sf))


@register("duplicate_rows")
def q_duplicate_rows(spark, sf):
    docs = table(spark, sf, "documents").select("text", "lang")
    conv = table(spark, sf, "conversations").select("role", "turn")
    parts = [
        ("documents_text_lang", docs),
        ("conversations_role_turn", conv),
        ("lineitem_gaps", lineitem_gaps(spark, sf)),
    ]
    out = None
    for name, d in parts:
        p = profile.duplicate_rows(d).select(F.lit(name).alias("table_name"), "*")
        out = p if out is None else out.unionByName(p)
    return out


@register("distinct_counts")
def q_distinct_counts(spark, sf):
    return profile.distinct_counts(lineitem_gaps(spark, sf))


@register("top_categories")
def q_top_categories(spark, sf):
    out = None
    for t in ("orders", "part", "conversations"):
        df = table(spark, sf, t)
        cats = [f.name for f in df.schema.fields if profile.column_class(f.dataType) == "categorical"]
        p = profile.top_values(df, 10, cats).select(F.lit(t).alias("table_name"), "column_name", "rank", "value",
                                                    "count")
        out = p if out is None else out.unionByName(p)
    return out


@register("describe_numeric")
def q_describe_numeric(spark, sf):
    d = profile.describe_numeric(lineitem_gaps(spark, sf))
    return d.select("column_idx", "column_name", "count", _r6("mean"), _r6("std"), "min", _r6("p25"), _r6("p50"),
                    _r6("p75"), "max")


@register("describe_categorical")
def q_describe_categorical(spark, sf):
    return profile.describe_categorical(table(spark, sf, "orders")).unionByName(
        profile.describe_categorical(lineitem_gaps(spark, sf)))


@register("correlation_matrix")
def q_correlation_matrix(spark, sf):
    gaps = lineitem_gaps(spark, sf)
    tax = F.when(F.col("l_orderkey") % 19 == 0, F.lit(float("inf"))).otherwise(F.col("l_tax"))
    c = correlation.correlation_matrix(gaps.withColumn("l_tax", tax))
    return c.select("i", "col_i", "j", "col_j", _r6("corr"), "truncated")


@register("logical_bytes")
def q_logical_bytes(spark, sf):
    return profile.logical_bytes(lineitem_gaps(spark, sf))


@register("quality_breakdown")
def q_quality_breakdown(spark, sf):
    return profile.quality_breakdown(lineitem_gaps(spark, sf))


@register("drop_empty_columns")
def q_drop_empty_columns(spark, sf):
    return profile.drop_empty_columns(lineitem_gaps(spark, sf))


@register("preview")
def q_preview(spark, sf):
    return sampling.preview(table(spark, sf, "orders"), ["o_orderkey"], 5)


@register("escape_html")
def q_escape_html(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", escape_html("html").alias("html_escaped"), escape_html("url").alias("url_escaped"))


# ---------------------------------------------------------------- step 3: sampling + split
@register("numeric_sample")
def q_numeric_sample(spark, sf):
    return sampling.numeric_sample(lineitem_gaps(spark, sf), ["l_orderkey", "l_linenumber"], 100)


@register("train_test_split")
def q_train_test_split(spark, sf):
    li = table(spark, sf, "lineitem")
    return sampling.with_split(li.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 0.8, 42)


@register("exact_split")
def q_exact_split(spark, sf):
    """Exactly ceil(n / 5) rows on the test side, of lineitem and of a table of few rows."""
    li = sampling.exact_split_flag(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 0.8, 42, "is_train")
    nation = sampling.exact_split_flag(table(spark, sf, "nation").select("n_nationkey"), ["n_nationkey"], 0.8, 42, "is_train")
    return li.select(F.lit("lineitem").alias("table_name"), F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("sub"), "is_train").unionByName(
        nation.select(F.lit("nation").alias("table_name"), F.col("n_nationkey").cast("long").alias("key"), F.lit(0).cast("long").alias("sub"), "is_train"))


def queries() -> dict[str, Query]:
    from tessera.plans import (  # noqa: F401  (modules register their queries)
        catalog_features,
        catalog_models,
        catalog_sources,
        catalog_target,
    )

    return dict(REGISTRY)
