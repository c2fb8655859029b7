import math

from tessera.operators import metrics


def test_weighted_metrics_with_never_predicted_class(spark):
    rows = [(0, 0), (0, 0), (1, 1), (1, 0), (2, 1), (2, 1)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    m = metrics.classification_metrics(df).first()
    # hand computation (support 2 each): class0 P=2/3 R=1; class1 P=1/3 R=1/2; class2 P=0 R=0
    p = (2 / 3 + 1 / 3 + 0) / 3
    r = (1 + 0.5 + 0) / 3
    f1 = (2 * (2 / 3) * 1 / (2 / 3 + 1) + 2 * (1 / 3) * 0.5 / (1 / 3 + 0.5) + 0) / 3
    assert math.isclose(m["accuracy"], 0.5) and math.isclose(m["precision"], p)
    assert math.isclose(m["recall"], r) and math.isclose(m["f1"], f1)


def test_r2_constant_target(spark):
    perfect = spark.createDataFrame([(2.0, 2.0)] * 3, "label double, prediction double")
    off = spark.createDataFrame([(2.0, 1.0)] * 3, "label double, prediction double")
    assert metrics.regression_metrics(perfect).first()["r2"] == 1.0
    assert metrics.regression_metrics(off).first()["r2"] == 0.0


def test_best_model_tie_and_missing(spark):
    board = spark.createDataFrame(
        [("a", 0, None, None), ("b", 1, 0.9, None), ("c", 2, 0.9, None)], "model string, model_idx int, accuracy double, r2 double")
    assert metrics.best_model(board, "classification").first()["model"] == "b"


def test_display_score(spark):
    board = spark.createDataFrame([("a", 0, 0.0, 0.5, 1.2), ("b", 1, None, None, 2.0), ("c", 2, 0.7, None, 1.0)],
                                  "model string, model_idx int, accuracy double, r2 double, training_time double")
    got = {r["model"]: r["display_score"] for r in metrics.display_score(board).collect()}
    assert got == {"a": 0.5, "b": 2.0, "c": 0.7}
