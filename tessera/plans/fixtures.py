"""Derived inputs shared by the Spark queries and their SQL oracles.

The driver tables have no nulls and no whole-row duplicates, so gaps are
injected inside the query — the same rule on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.readers import read_fixture

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_fixture(spark, sf_dir, name)


def lineitem_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(k % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(k % 13 == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax",
        F.when(k % 11 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate",
        F.lit(None).cast("string").alias("l_note"),
    )


LINEITEM_GAPS_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
       l_extendedprice,
       CASE WHEN l_orderkey % 13 = 0 THEN 'NaN'::DOUBLE ELSE l_discount END AS l_discount,
       l_tax,
       CASE WHEN l_orderkey % 11 <> 0 THEN l_returnflag END AS l_returnflag,
       l_linestatus, l_shipdate,
       CAST(NULL AS VARCHAR) AS l_note
FROM lineitem
"""

# (name, kind) of lineitem_gaps; kind: int | float | str | ts
LINEITEM_GAPS_COLUMNS = [
    ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
    ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"),
    ("l_returnflag", "str"), ("l_linestatus", "str"), ("l_shipdate", "ts"), ("l_note", "str"),
]

# column kinds of the driver tables (for generated oracle SQL)
TABLE_COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "str")],
    "nation": [("n_nationkey", "int"), ("n_name", "str"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "int"), ("c_name", "str"), ("c_nationkey", "int"), ("c_acctbal", "float"),
                 ("c_mktsegment", "str")],
    "supplier": [("s_suppkey", "int"), ("s_name", "str"), ("s_nationkey", "int"), ("s_acctbal", "float")],
    "part": [("p_partkey", "int"), ("p_name", "str"), ("p_brand", "str"), ("p_type", "str"), ("p_size", "int"),
             ("p_retailprice", "float")],
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"), ("o_totalprice", "float"),
               ("o_orderdate", "ts"), ("o_orderpriority", "str")],
    "lineitem": [(n, k) for n, k in LINEITEM_GAPS_COLUMNS if n != "l_note"],
    "events": [("event_id", "int"), ("ts", "ts"), ("user_id", "int"), ("event_type", "str"), ("value", "float"),
               ("props", "str")],
    "documents": [("doc_id", "int"), ("text", "str"), ("lang", "str"), ("source", "str"), ("n_chars", "int")],
    "embeddings": [("vec_id", "int"), ("embedding", "array"), ("label", "int")],
    "pages": [("page_id", "int"), ("url", "str"), ("html", "str")],
    "benchmark": [("item_id", "int"), ("text", "str")],
    "labels": [("doc_id", "int"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "int"), ("turn", "int"), ("role", "str"), ("text", "str")],
}


def part_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        "p_partkey", "p_name",
        F.when(k % 17 != 0, F.col("p_brand")).alias("p_brand"),
        F.when(k % 19 != 0, F.col("p_type")).alias("p_type"),
        "p_size",
        F.when(k % 23 != 0, F.col("p_retailprice")).alias("p_retailprice"),
    )


PART_GAPS_SQL = """
SELECT p_partkey, p_name,
       CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS p_brand,
       CASE WHEN p_partkey % 19 <> 0 THEN p_type END AS p_type,
       p_size,
       CASE WHEN p_partkey % 23 <> 0 THEN p_retailprice END AS p_retailprice
FROM part
"""
