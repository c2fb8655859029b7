import math

from pyspark.sql import functions as F

from tessera.operators import correlation, profile


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_nan_and_null_are_one_missing(spark):
    df = _frame(spark, [(float("nan"), None, None), (None, "", None), (1.0, "x", None)], "a double, b string, c int")
    prof = {r["column_name"]: r for r in profile.column_profile(df).collect()}
    assert prof["a"]["missing"] == 2 and prof["a"]["distinct_count"] == 1
    assert prof["b"]["missing"] == 1 and prof["b"]["distinct_count"] == 2  # '' is a value in Spark data
    assert prof["c"]["missing"] == 3 and prof["c"]["distinct_count"] == 0
    assert prof["a"]["missing_pct"] == 66.67
    kept = profile.drop_empty_columns(df).columns
    assert kept == ["a", "b"]


def test_column_classes(spark):
    df = spark.sql("SELECT 1 AS i, 1.5D AS f, 's' AS s, true AS b, date'2020-01-01' AS d, "
                   "timestamp'2020-01-01 00:00:00' AS ts, CAST(1.25 AS DECIMAL(10,2)) AS dec, array(1) AS arr")
    classes = {r["column_name"]: r["column_class"] for r in profile.column_types(df).collect()}
    assert classes == {"i": "numeric", "f": "numeric", "s": "categorical", "b": "other", "d": "other",
                       "ts": "other", "dec": "numeric", "arr": "other"}
    dist = profile.column_type_distribution(df).first()
    assert (dist["numeric"], dist["categorical"], dist["total"]) == (3, 1, 8)


def test_duplicates_treat_null_and_nan_equal(spark):
    # one notion of missing: in a float column null and NaN are the same cell value
    rows = [("a", None), ("a", None), ("a", float("nan")), ("a", float("nan")), ("b", 1.0), (None, 1.0), (None, 1.0)]
    df = _frame(spark, rows, "a string, b double")
    r = profile.duplicate_rows(df).first()
    assert (r["rows"], r["distinct_rows"], r["duplicate_rows"]) == (7, 3, 4)


def test_table_profile_scores(spark):
    df = _frame(spark, [(1.0, None), (None, "x"), (3.0, "y"), (3.0, "y")], "a double, b string")
    t = profile.table_profile(df).first()
    assert t["rows"] == 4 and t["cols"] == 2 and t["total_missing"] == 2
    assert t["completeness_pct"] == 75.0 and t["quality_score"] == 75.0 and t["duplicate_rows"] == 1


def test_empty_table_quality_is_100(spark):
    df = _frame(spark, [], "a double")
    t = profile.table_profile(df).first()
    assert t["rows"] == 0 and t["quality_score"] == 100.0 and t["completeness_pct"] is None


def test_top_values_ties_and_limit(spark):
    rows = [(v,) for v in ["b", "a", "c", "a", "b", "d"] + [f"z{i}" for i in range(20)]]
    df = _frame(spark, rows, "s string")
    top = profile.top_values(df, 3).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == [("a", 2), ("b", 2), ("c", 1)]


def test_correlation_constant_and_pairwise(spark):
    rows = [(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 6.0), (4.0, 5.0, 8.0)]
    df = _frame(spark, rows, "a double, k double, b double")
    c = {(r["col_i"], r["col_j"]): r["corr"] for r in correlation.correlation_matrix(df).collect()}
    assert c[("a", "k")] is None and c[("k", "k")] is None
    assert math.isclose(c[("a", "a")], 1.0)
    # pairwise complete: rows 1, 3, 4 → perfectly correlated pairs (1,2),(3,6),(4,8)
    import numpy as np

    expected = np.corrcoef([1, 3, 4], [2, 6, 8])[0, 1]
    assert math.isclose(c[("a", "b")], expected, rel_tol=1e-12)
    assert c[("a", "b")] == c[("b", "a")]


def test_correlation_cap_and_flag(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1) + F.rand(i)).alias(f"c{i}") for i in range(30)])
    c = correlation.correlation_matrix(df, max_cols=25)
    rows = c.collect()
    assert len(rows) == 25 * 25 and all(r["truncated"] for r in rows)
    assert all(-1.0 <= r["corr"] <= 1.0 for r in rows)


def test_fewer_than_two_numeric_gives_empty(spark):
    df = _frame(spark, [(1.0, "x")], "a double, s string")
    assert correlation.correlation_matrix(df).count() == 0


def test_profile_invariant_to_row_order_and_partitioning(spark):
    df = spark.range(300).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).cast("string").alias("s"))
    p1 = sorted(profile.column_profile(df).collect())
    p2 = sorted(profile.column_profile(df.repartition(13).orderBy(F.rand(1))).collect())
    assert p1 == p2


def test_describe_numeric_matches_pandas(spark):
    import pandas as pd

    vals = [1.0, 2.0, 2.0, 10.0, None, 7.5]
    df = _frame(spark, [(v,) for v in vals], "x double")
    d = profile.describe_numeric(df).first()
    s = pd.Series(vals, dtype="float64")
    assert d["count"] == s.count()
    assert math.isclose(d["mean"], s.mean()) and math.isclose(d["std"], s.std())
    for q, k in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
        assert math.isclose(d[k], s.quantile(q))


def test_profile_bundle(spark):
    df = spark.range(200).select(
        F.col("id"), (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("s"),
        F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") * 2.0).alias("y"))
    b = profile.profile(df)
    assert set(b) == {"table", "schema", "type_distribution", "columns", "top_values", "describe_categorical", "quality_breakdown",
                      "samples", "correlation", "describe_numeric", "logical_bytes"}
    assert all(d.count() for d in b.values())
    t = b["table"].first()
    assert t["rows"] == 200 and t["cols"] == 4 and t["total_missing"] == 50
    assert b["columns"].count() == 4 and b["top_values"].count() == 3
    assert b["samples"].groupBy("column_name").count().count() == 3
    assert b["correlation"].count() == 9


def test_compact_keys_count_like_full_text(spark):
    from tests.conftest import SMOKE

    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("text", "lang")
    full = profile.column_profile(docs, profile.frequency_table(docs)).orderBy("column_idx").collect()
    compact = profile.column_profile(docs, profile.frequency_table(docs, compact=True)).orderBy("column_idx").collect()
    assert full == compact
    assert docs.select("text").distinct().count() == full[0]["distinct_count"]


def test_dotted_and_spaced_column_names(spark):
    from tessera.operators import features as fx
    from tessera.operators import target as tg

    df = spark.range(40).select(
        (F.col("id") % 3).cast("string").alias("Sepal.Kind"), (F.col("id") * 0.5).alias("petal width"),
        (F.col("id") % 2).cast("int").alias("y"))
    prof = {r["column_name"]: r["distinct_count"] for r in profile.column_profile(df).collect()}
    assert prof == {"Sepal.Kind": 3, "petal width": 40, "y": 2}
    assert tg.detect_target(df) == ("y", "binary")
    assert fx.fit_features(df, "y").feature_names() == ["num__petal width", "cat__Sepal.Kind_1", "cat__Sepal.Kind_2"]
    assert profile.top_values(df, 1).first()["column_name"] == "Sepal.Kind"
    assert profile.describe_numeric(df).count() == 2 and profile.duplicate_rows(df).first()["duplicate_rows"] == 0
