import pytest
from pyspark.sql import functions as F

from tessera.operators import target


def test_name_match_is_case_insensitive(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "x int, Label string")
    assert target.detect_target(df) == ("Label", "binary")
    assert target.detect_target_frame(df).first()["target"] == "Label"


@pytest.mark.parametrize("k,expected", [(1, "regression"), (2, "binary"), (3, "multiclass"), (10, "multiclass"),
                                        (11, "multiclass"), (19, "multiclass"), (20, "regression")])
def test_numeric_problem_type_thresholds(spark, k, expected):
    df = spark.range(60).select((F.col("id") % k).cast("int").alias("y"), F.col("id").alias("id"))
    r = target.problem_types(df).where("column_name = 'y'").first()
    assert r["unique_values"] == k and r["problem_type"] == expected


def test_text_types_and_fallback_rules():
    assert target.problem_type_rule(False, 2) == "binary"
    assert target.problem_type_rule(False, 30) == "multiclass"
    assert target.family("binary") == target.family("multiclass") == "classification"
    assert target.family("clustering") == "regression"


def test_first_text_or_low_cardinality_column(spark):
    df = spark.range(40).select(F.col("id").alias("a"), (F.col("id") % 4).alias("b"), F.col("id").cast("string").alias("c"))
    assert target.detect_target(df) == ("b", "multiclass")
    df2 = spark.range(40).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    assert target.detect_target(df2)[0] == "b"  # last non-empty column


def test_all_missing_columns_are_ignored(spark):
    df = spark.createDataFrame([(None, 1.5), (None, 2.5)], "target string, v double")
    assert target.detect_target(df)[0] == "v"


def test_substring_preselect_last_wins():
    assert target.target_by_substring(["x", "my_label", "day"]) == "day"


def test_analyze_target_whole_number_rule(spark):
    half = spark.createDataFrame([(i, v) for i, v in enumerate([0.5, 1.0, 1.5, 2.0, 2.5] * 3)], "k int, y double")
    r = target.analyze_target(half, "y", ["k"]).first()
    assert r["unique_count"] == 5 and r["detected_type"] == "regression" and r["type_confidence"] == "high"
    whole = spark.createDataFrame([(i, float(i % 3)) for i in range(12)], "k int, y double")
    r = target.analyze_target(whole, "y", ["k"]).first()
    assert r["detected_type"] == "classification"
    assert r["sample_values"].startswith("0.0, 1.0, 2.0")
    err = target.analyze_target(whole, "nope").first()
    assert not err["success"] and "not found" in err["error"]


@pytest.mark.parametrize("n,too_small", [(0, True), (9, True), (10, False)])
def test_validation_minimum_rows(spark, n, too_small):
    df = spark.range(n).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    r = target.validate_config(df, "y", "regression", 0.8).first()
    assert ("too small" in (r["errors"] or "")) == too_small


def test_validation_collects_all_errors(spark):
    df = spark.createDataFrame([(1.0, 1)] * 3, "x double, y int")
    r = target.validate_config(df, "y", "clustering", "abc").first()
    assert not r["valid"]
    assert r["errors"].split(" | ") == [
        "Invalid problem type 'clustering'. Must be one of ['classification', 'regression', 'binary', 'multiclass']",
        "Split ratio must be a valid number",
        "Dataset too small. Need at least 10 rows for training",
    ]
    r = target.validate_config(spark.range(20).select(F.lit(1).alias("y")), "y", "binary", 1.0).first()
    assert r["errors"] == ("Split ratio must be between 0 and 1 | "
                           "Classification requires at least 2 unique target values, found 1")


def test_upload_type_labels(spark):
    df = spark.sql("SELECT 1 AS i, true AS b, 's' AS s, date'2020-01-01' AS d")
    got = {r["column_name"]: r["label"] for r in target.upload_type_labels(df).collect()}
    assert got == {"i": "numeric", "b": "numeric", "s": "categorical", "d": "categorical"}


def test_targets_of_many_tables_equal_the_rule(spark):
    """Every way a table can be settled: by name, few numbers, bounded sets that fill up late, text, the last column, nothing."""
    from tessera.operators import target as t

    i = F.col("id")
    base = spark.range(6000)
    tables = {
        "named": base.select(i, (i % 30).alias("Y"), F.lit("a").alias("s")),
        "named_empty": base.select(i, F.lit(None).cast("int").alias("label"), (i % 3).alias("n")),
        "few": base.select(i, (i % 9).cast("double").alias("n"), i.cast("string").alias("s")),
        "late": base.select(i, F.when(i < 4000, i % 3).otherwise(i).alias("n"), (i % 4 == 0).alias("b"), i.cast("string").alias("s")),
        "late_text": base.select(i, F.when(i > 5500, F.lit("x")).alias("late"), i.cast("string").alias("s")),
        "text": base.select(i, F.concat(F.lit("v"), i % 2).alias("s"), (i % 2).alias("n")),
        "last": base.select(i, (i + 0.5).alias("x")),
        "none": base.select(F.lit(None).cast("string").alias("s")),
        "empty": base.select(i).limit(0),
        "decimals": base.select(i, (i % 10).cast("decimal(12,3)").alias("dec"), F.make_date(F.lit(2020), F.lit(1), (i % 3 + 1).cast("int")).alias("day"), F.lit("q").alias("s")),
    }
    want = []
    for name, df in tables.items():
        stats = t.column_stats(df)
        if any(s.present for s in stats):
            c = t.choose_target(stats)
            want.append((name, c.name, t.problem_type_rule(c.loose_numeric, c.unique), c.unique))
    assert t.detect_targets(tables) == want
    assert t.detect_targets(tables, head_rows=1) == want
    assert [tuple(r) for r in t.detect_target_frame(tables["late"]).collect()] == [want[[w[0] for w in want].index("late")][1:]]
    sets = t.bounded_sets(tables["late"].repartition(3), [0, 1, 2], 11).groupBy("i").count().collect()
    assert {r["i"]: r["count"] >= 11 for r in sets} == {0: True, 1: True, 2: False}
