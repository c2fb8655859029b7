"""Ordinary inputs that once gave wrong answers."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions.scalars import json_safe_row, pct2
from tessera.operators import correlation, features, sampling
from tessera.operators.importance import permutation_importance
from tessera.operators.models import TrainConfig, compare_models, fit_partitions, index_numeric_labels
from tessera.sources import readers, sinks
from tessera.sources.excel import read_xlsx


def test_infinite_cells_take_no_part_in_a_correlation(spark):
    rows = [(float(i), float((i * 7) % 11)) for i in range(30)]
    plain = {(r.i, r.j): r["corr"] for r in correlation.correlation_matrix(spark.createDataFrame(rows, "a double, b double")).collect()}
    odd = {(r.i, r.j): r["corr"] for r in correlation.correlation_matrix(spark.createDataFrame([*rows, (math.inf, 3.0), (-math.inf, 9.0)], "a double, b double")).collect()}
    assert abs(plain[0, 1] - odd[0, 1]) < 1e-12 and abs(odd[0, 0] - 1) < 1e-12


def test_correlation_covers_all_columns(spark):
    df = spark.range(20).select(*[(F.col("id") * (k + 1) % 7).cast("double").alias(f"c{k}") for k in range(30)])
    out = correlation.correlation_matrix(df)
    assert out.count() == 900 and not out.where("truncated").count()
    assert correlation.correlation_matrix(df, max_cols=5).where("truncated").count() == 25


def _csv(tmp_path, text):
    (tmp_path / "t.csv").write_text(text)
    return str(tmp_path / "t.csv")


def test_csv_text_like_numbers_stays_text(spark, tmp_path):
    df = readers.read_csv(spark, _csv(tmp_path, "a,b,`c\n1d,0x1p3,1e3\n2f,7,-.5\n"))
    assert dict(df.dtypes) == {"a": "string", "b": "string", "`c": "double"}


def test_csv_quoted_line_break_and_short_row(spark, tmp_path):
    rows = readers.read_csv(spark, _csv(tmp_path, 'id,t\n1,"line1\nline2, ""x"""\n2\n')).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'line1\nline2, "x"'), (2, None)]


def test_csv_extra_cells_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="more than the 2 cells"):
        readers.read_csv(spark, _csv(tmp_path, "id,t\n1,x\n3,y,EXTRA\n"))


def _workbook(path, rows):
    cell = lambda c, r, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{r}">{"".join(cell(c, r, v) for c, v in enumerate(vs))}</row>' for r, vs in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="s"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_excel_follows_each_header(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", [["id", "amt"], ["1", "10"]])
    _workbook(tmp_path / "b.xlsx", [["amt", "id", "extra"], ["20", "2", "e"]])
    _workbook(tmp_path / "C.XLSX", [["id", "id"], ["3", "4"]])
    df = read_xlsx(spark, str(tmp_path))
    got = {r["id"]: r.asDict() for r in df.collect()}
    assert got == {1: {"id": 1, "id.1": None, "amt": 10, "extra": None}, 2: {"id": 2, "id.1": None, "amt": 20, "extra": "e"}, 3: {"id": 3, "id.1": 4, "amt": None, "extra": None}}


def test_xls_is_refused():
    assert not readers.validate_upload("x.xls", 5)[0] and readers.validate_upload("X.XLSX", 5)[0]


def test_sample_without_keys_is_not_biased(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    values = [r.value for r in sampling.numeric_sample(df).where("column_name = 'v'").collect()]
    assert len(values) == 100 and max(values) > 10_000 and {v % 2 for v in values} == {0.0, 1.0}


def test_sample_covers_all_columns(spark):
    df = spark.range(10).select(*[(F.col("id") + k).alias(f"c{k}") for k in range(6)])
    assert sampling.numeric_sample(df, n=4).count() == 24


def test_json_is_safe_at_any_depth(spark):
    df = spark.sql("SELECT array(double('NaN'), 1.0D) a, named_struct('x', float('inf'), 'y', cast('b' AS binary)) s, map('k', double('NaN')) m, cast(null AS struct<z: double>) n")
    text = df.select(json_safe_row(df.schema.fields).alias("j")).first()["j"]
    assert json.loads(text) == {"a": [None, 1.0], "s": {"x": None, "y": "b"}, "m": {"k": None}, "n": None}


def test_percentages_of_large_counts(spark):
    assert spark.range(1).select(pct2(F.lit(333_333_333_333_333), F.lit(10**15)).alias("p")).first()["p"] == 33.33


def test_exact_split_of_a_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    cfg = TrainConfig("s_acctbal", "regression", split_keys=("s_suppkey",), exact_split=True, models=("LinearRegression",))
    res = compare_models(df, cfg)
    assert res.best_metrics["r2"] is not None and res.best_metrics["mse"] is not None
    train, test = sampling.train_test_split(df, ["s_suppkey"], exact=True)
    assert (train.count(), test.count()) == (8, 2)
    with pytest.raises(ValueError, match="Empty split"):
        compare_models(df.limit(10).withColumn("s_suppkey", F.lit(1)), TrainConfig("s_acctbal", "regression", split_keys=("s_suppkey",), models=("LinearRegression",)))


def test_ratio_near_one_keeps_a_test_side(spark):
    df = spark.range(100_000)
    assert df.where(~sampling.split_flag(["id"], 0.99999)).count() > 0


def _classes(spark, k, n=3000):
    return spark.range(n).select("id", (F.col("id") % k).cast("double").alias("x"), (F.col("id") % k).cast("string").alias("text"), (F.col("id") % k * 3).alias("num"))


def test_more_than_a_hundred_classes_keep_the_trees(spark):
    df = _classes(spark, 120).drop("num")
    res = compare_models(df, TrainConfig("text", "multiclass", split_keys=("id",), models=("DecisionTree",), max_bins=128))
    assert list(res.models) == ["DecisionTree"] and res.best_metrics["accuracy"] > 0.5


def test_many_numeric_classes(spark):
    out, k = index_numeric_labels(_classes(spark, 1500).select(F.col("num").cast("double").alias("label")))
    assert k == 1500 and sorted({r.label for r in out.collect()}) == [float(i) for i in range(1500)]


def test_slow_models_are_kept(spark):
    res = compare_models(_classes(spark, 3).drop("num"), TrainConfig("text", "multiclass", split_keys=("id",), models=("DecisionTree",), timeout_seconds=0.0))
    assert res.over_budget == ["DecisionTree"] == list(res.models)


def test_unseen_classes_count_as_errors(spark):
    df = _classes(spark, 2).drop("num")
    odd = df.where("id < 400").withColumn("text", F.concat(F.lit("only"), F.col("id").cast("string")))  # each class on one side only
    both = df.where("id >= 400").unionByName(odd)
    cfg = TrainConfig("text", "multiclass", split_keys=("id",), models=("DecisionTree",), fit_scope="train")
    res = compare_models(both, cfg)
    test = both.where(~sampling.split_flag(["id"], 0.8, 42))
    share = test.where("text LIKE 'only%'").count() / test.count()
    assert res.best_metrics["accuracy"] <= 1 - share + 1e-9


def test_forest_does_not_depend_on_the_partitioning(spark):
    df = spark.range(3000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("y", F.col("a") * 3 + F.sin("b"))
    fixed = spark.createDataFrame(df.collect(), df.schema)
    cfg = TrainConfig("y", "regression", split_keys=("id",), models=("RandomForest",), num_trees=5, max_depth=4)
    scores = {compare_models(fixed.repartition(p), cfg).best_metrics["r2"] for p in (1, 2, 5)}
    assert len(scores) == 1 and fit_partitions(15_000) >= 8


def test_every_regressor_scores_rows_without_a_target(spark, tmp_path):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"), ((F.col("id") % 10) * 2.0).alias("y"))
    res = compare_models(df, TrainConfig("y", "regression", split_keys=("id",), num_trees=3, boost_iters=3, max_depth=3, rff_dim=16))
    assert len(res.models) == 5, res.skipped
    for name in res.models:
        res.best_model_name = name
        pkg = sinks.load_package(spark, sinks.save_package(res, str(tmp_path / name)))
        assert pkg.score(df.drop("y")).where("prediction IS NOT NULL").count() == 200


def test_date_target_and_missing_columns_are_named(spark):
    df = spark.range(20).select("id", F.current_date().alias("d"))
    with pytest.raises(ValueError, match="has type date"):
        features.fit_features(df, "d")
    fm = features.fit_features(spark.range(20).select("id", F.lit("x").alias("t")), "t")
    with pytest.raises(ValueError, match="Missing feature columns: id"):
        fm.transform(spark.range(2).select(F.lit(1).alias("other")))
    with pytest.raises(ValueError, match="another type"):
        fm.transform(spark.range(2).select(F.lit("1").alias("id")))


def test_permutation_importance_does_not_depend_on_the_partitioning(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")))
    df = spark.createDataFrame(df.withColumn("label", F.col("a") * 2 + F.col("b")).select("features", "label").collect())
    model = LinearRegression().fit(df)
    values = {tuple(round(r.importance, 12) for r in sorted(permutation_importance(model, df.repartition(p), ["a", "b"], "regression").collect())) for p in (1, 3, 7)}
    assert len(values) == 1 and min(next(iter(values))) > 0


def test_no_machine_local_folder_on_a_cluster():
    from tessera.session import checkpoint_root

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_exact_quantiles_against_numpy(spark):
    import numpy as np

    from tessera.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(4)
    columns = {"u": rng.normal(size=30_000), "ties": rng.integers(0, 3, 30_000).astype(float), "steep": np.exp(rng.normal(size=30_000) * 8), "few": np.r_[1.0, 2.0, 4.0, np.full(29_997, np.nan)], "none": np.full(30_000, np.nan)}
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    got = {(r.column_idx, r.prob_idx): r.value for r in exact_quantiles(df, list(columns), (0.0, 0.25, 0.5, 0.999, 1.0)).collect()}
    for i, (name, x) in enumerate(columns.items()):
        x = x[~np.isnan(x)]
        for k, q in enumerate((0.0, 0.25, 0.5, 0.999, 1.0)):
            if len(x):
                assert abs(got[i, k] - np.quantile(x, q)) <= 1e-9 * abs(np.quantile(x, q)) + 1e-12, (name, q)
            else:
                assert (i, k) not in got
