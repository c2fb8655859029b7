from pyspark.sql import functions as F

from tessera.operators.models import TrainConfig, compare_models
from tessera.sources import sinks

FAST = ("LogisticRegression", "DecisionTree", "LinearRegression")


def _signal(spark, n=400):
    return spark.range(n).select(
        F.col("id"),
        (F.col("id") % 10).cast("double").alias("x1"),
        F.rand(7).alias("noise"),
        F.when(F.col("id") % 10 >= 5, "hi").otherwise("lo").alias("cls"),
        ((F.col("id") % 10) * 3.0 + F.rand(3)).alias("yreg"),
    )


def test_classification_beats_majority(spark):
    df = _signal(spark).drop("yreg")
    res = compare_models(df, TrainConfig("cls", "binary", split_keys=("id",), models=FAST))
    assert res.family == "classification"
    best = res.best_metrics
    assert best["accuracy"] >= 0.9
    assert set(res.models) == {"LogisticRegression", "DecisionTree"}
    assert res.importance.where("model = 'DecisionTree'").count() == len(res.feature_names)


def test_regression_and_package_roundtrip(spark, tmp_path):
    df = _signal(spark).drop("cls")
    res = compare_models(df, TrainConfig("yreg", "regression", split_keys=("id",), models=FAST))
    assert res.best_metrics["r2"] > 0.9
    path = sinks.save_package(res, str(tmp_path / "pkg"))
    pkg = sinks.load_package(spark, path)
    a = sorted(pkg.score(df, keep=["id"]).collect())
    enc = res.features.transform(df, keep=["id"])
    b = sorted(res.models[res.best_model_name].transform(enc).select("id", "prediction").collect())
    assert a == b


def test_export_layout(spark, tmp_path):
    df = _signal(spark).drop("yreg")
    res = compare_models(df, TrainConfig("cls", "binary", split_keys=("id",), models=FAST))
    t = sinks.leaderboard_table(res.leaderboard, res.best_model_name, res.family)
    assert t.columns == ["Model", "Best_Model", "Training_Time", "Accuracy", "Precision", "Recall", "F1"]
    assert sorted(r["Best_Model"] for r in t.collect()) == ["No", "Yes"]


def test_deterministic_for_seed(spark):
    df = _signal(spark).drop("yreg")
    cfg = TrainConfig("cls", "binary", split_keys=("id",), models=("DecisionTree",))
    a = compare_models(df, cfg).best_metrics
    b = compare_models(df, cfg).best_metrics
    assert a["accuracy"] == b["accuracy"] and a["f1"] == b["f1"]


def test_failing_model_is_skipped(spark, monkeypatch):
    from tessera.operators import models as M

    def boom(ctx):
        raise RuntimeError("boom")

    reg = dict(M.REGISTRY)
    reg["classification"] = [("Broken", boom)] + [m for m in M.REGISTRY["classification"] if m[0] == "DecisionTree"]
    monkeypatch.setattr(M, "REGISTRY", reg)
    res = compare_models(_signal(spark).drop("yreg"), TrainConfig("cls", "binary", split_keys=("id",)))
    assert "Broken" in res.skipped and list(res.models) == ["DecisionTree"]


def test_run_store(spark, tmp_path):
    store = sinks.RunStore(spark, str(tmp_path / "runs"))
    store.put("r1", "board", spark.createDataFrame([("a", 1.0)], "m string, s double"))
    store.put("r2", "board", spark.createDataFrame([("b", 2.0)], "m string, s double"))
    assert store.get("r1", "board").collect()[0]["m"] == "a"
    store.clear("r1")
    assert store.get("r1", "board").count() == 0 and store.get("r2", "board").count() == 1


def test_cross_validate_folds(spark):
    from tessera.operators.models import cross_validate

    df = _signal(spark).drop("yreg")
    cv = cross_validate(df, TrainConfig("cls", "binary", split_keys=("id",), models=("DecisionTree",)), folds=3)
    r = cv.first()
    assert r["model"] == "DecisionTree" and r["folds"] == 3 and r["mean_score"] > 0.9


def _brute_classification(pairs):
    classes = sorted({y for y, _ in pairs} | {p for _, p in pairs})
    n = len(pairs)
    acc = sum(y == p for y, p in pairs) / n
    prec = rec = f1 = 0.0
    for c in classes:
        tp = sum(1 for y, p in pairs if y == c and p == c)
        sup = sum(1 for y, _ in pairs if y == c)
        pred = sum(1 for _, p in pairs if p == c)
        pc = tp / pred if pred else 0.0
        rc = tp / sup if sup else 0.0
        fc = 2 * pc * rc / (pc + rc) if pc + rc else 0.0
        prec, rec, f1 = prec + sup * pc / n, rec + sup * rc / n, f1 + sup * fc / n
    return acc, prec, rec, f1


def test_leaderboard_matches_brute_force(spark):
    import math

    from tessera.operators.sampling import split_flag

    df = _signal(spark, 300).drop("yreg").withColumn(
        "cls", F.when(F.col("id") % 7 == 0, "mid").otherwise(F.col("cls")))
    res = compare_models(df, TrainConfig("cls", "multiclass", split_keys=("id",), models=FAST))
    test = res.features.transform(df.where(~split_flag(["id"], 0.8, 42)))
    for row in res.leaderboard.collect():
        pairs = [(r["label"], r["prediction"]) for r in res.models[row["model"]].transform(test).collect()]
        want = _brute_classification(pairs)
        got = (row["accuracy"], row["precision"], row["recall"], row["f1"])
        assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for a, b in zip(got, want))


def test_linear_importance_is_abs_coefficients(spark):
    df = _signal(spark).drop("cls")
    res = compare_models(df, TrainConfig("yreg", "regression", split_keys=("id",), models=("LinearRegression",)))
    coefs = [abs(c) for c in res.models["LinearRegression"].coefficients.toArray()]
    imp = {r["feature"]: r["importance"] for r in res.importance.collect()}
    assert [imp[f] for f in res.feature_names] == coefs
