"""Model registry and the compare job (validate → features → split → fit each → score → pick → explain).

Every fit is an MLlib estimator (distributed training); the encoded table is
persisted once and reused by all five fits.  Only metrics, importances and
fitted models come back to the driver.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StandardScaler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.features import BROADCAST_CODES, FeatureModel, fit_features
from tessera.operators.kernels import KernelClassification, KernelRegression, RandomFourierFeatures
from tessera.operators.metrics import LEADERBOARD_SCHEMA, classification_metrics, regression_metrics
from tessera.operators.svc import fit_svc
from tessera.operators.svr import fit_svr
from tessera.operators.sampling import dense_index, exact_split_flag, split_flag
from tessera.operators.target import check_config, family
from tessera.operators.trees import fit_boosted, fit_forest
from tessera.functions.types import qcol
from tessera.session import checkpoint_root


#: Training rows up to which MLlib fits the trees; beyond that ``operators.trees`` does.
MLLIB_ROWS = 20_000


def fit_partitions(n_rows: int) -> int:
    """Partitions of the encoded table from its row count alone, so a model does not depend on the cluster."""
    return max(1, math.ceil(n_rows ** 0.6 / 40))


@dataclass(frozen=True)
class TrainConfig:
    target: str
    problem_type: str
    train_ratio: float = 0.8  # test share = 1 − ratio
    seed: int = 42
    timeout_seconds: float | None = None  # a slower model is kept and marked in ``over_budget``
    interrupt: bool = False  # cancel the jobs of a fit at ``timeout_seconds`` and skip the model
    num_trees: int = 100
    boost_iters: int = 100
    boost_depth: int = 3
    max_depth: int = 30  # MLlib maximum; the reference grows trees without a limit
    max_bins: int = 32
    rff_dim: int = 256
    svr_loss: str = "epsilon"  # or "huber"
    fit_scope: str = "all"  # "all" (reference) or "train"
    split_keys: tuple[str, ...] | None = None
    exact_split: bool = False  # exactly ceil(n · (1 − ratio)) test rows instead of hash buckets
    models: tuple[str, ...] | None = None  # subset of the registry, by name


@dataclass
class FitContext:
    n_train: int
    num_classes: int
    dim: int
    cfg: TrainConfig
    train: DataFrame


Builder = Callable[[FitContext], object]


def _lr(ctx):
    return LogisticRegression(maxIter=1000, regParam=1.0 / max(ctx.n_train, 1), elasticNetParam=0.0,
                              standardization=False, family="auto")


# execution-only knobs (no effect on the fitted model): cache each row's node id between levels
# instead of re-walking every tree, and let forests aggregate more nodes per pass
_TREE_EXEC = {"cacheNodeIds": True, "checkpointInterval": 10}
_FOREST_EXEC = dict(_TREE_EXEC, maxMemoryInMB=1024)
# a boosted tree is too shallow for that: its three levels are walked faster than the ids are kept and checkpointed
_BOOST_EXEC = {"cacheNodeIds": False, "checkpointInterval": 10}


class _HistogramTrees:
    """The tree models of tables beyond ``MLLIB_ROWS``: a boosted model, a forest or a single tree of all rows."""

    def __init__(self, ctx: FitContext, kind: str, classify: bool):
        self.ctx, self.kind, self.classes = ctx, kind, max(ctx.num_classes, 2) if classify else 0

    def fit(self, train: DataFrame):
        ctx, cfg = self.ctx, self.ctx.cfg
        if self.kind == "boosted":
            return fit_boosted(train, ctx.dim, ctx.n_train, self.classes, cfg.boost_iters, cfg.boost_depth, cfg.max_bins, cfg.seed)
        forest = self.kind == "forest"
        wanted = math.ceil(math.sqrt(ctx.dim)) if forest and self.classes else ctx.dim
        return fit_forest(train, ctx.dim, ctx.n_train, self.classes, cfg.num_trees if forest else 1, cfg.max_depth, cfg.max_bins, cfg.seed, forest, wanted)


def _rf_c(ctx):
    if ctx.n_train > MLLIB_ROWS:
        return _HistogramTrees(ctx, "forest", True)
    return RandomForestClassifier(numTrees=ctx.cfg.num_trees, featureSubsetStrategy="sqrt",
                                  maxDepth=ctx.cfg.max_depth, maxBins=ctx.cfg.max_bins, seed=ctx.cfg.seed,
                                  **_FOREST_EXEC)


def _gb_c(ctx):
    if ctx.n_train > MLLIB_ROWS:
        return _HistogramTrees(ctx, "boosted", True)
    gbt = GBTClassifier(maxIter=ctx.cfg.boost_iters, maxDepth=ctx.cfg.boost_depth, stepSize=0.1,
                        maxBins=ctx.cfg.max_bins, seed=ctx.cfg.seed, **_BOOST_EXEC)
    return gbt if ctx.num_classes <= 2 else OneVsRest(classifier=gbt, parallelism=_ovr_threads(ctx))


def _dt_c(ctx):
    if ctx.n_train > MLLIB_ROWS:
        return _HistogramTrees(ctx, "tree", True)
    return DecisionTreeClassifier(maxDepth=ctx.cfg.max_depth, maxBins=ctx.cfg.max_bins, seed=ctx.cfg.seed,
                                  **_TREE_EXEC)


def _ovr_threads(ctx) -> int:
    """Per-class models are independent jobs: submit up to 8 at once (same models, less idle time)."""
    return max(1, min(ctx.num_classes, 8))


def _lin(ctx):
    return LinearRegression(regParam=0.0, solver="auto")


def _rf_r(ctx):
    if ctx.n_train > MLLIB_ROWS:
        return _HistogramTrees(ctx, "forest", False)
    return RandomForestRegressor(numTrees=ctx.cfg.num_trees, featureSubsetStrategy="all",
                                 maxDepth=ctx.cfg.max_depth, maxBins=ctx.cfg.max_bins, seed=ctx.cfg.seed,
                                 **_FOREST_EXEC)


def _gb_r(ctx):
    if ctx.n_train > MLLIB_ROWS:
        return _HistogramTrees(ctx, "boosted", False)
    return GBTRegressor(maxIter=ctx.cfg.boost_iters, maxDepth=ctx.cfg.boost_depth, stepSize=0.1,
                        maxBins=ctx.cfg.max_bins, seed=ctx.cfg.seed, **_BOOST_EXEC)


def _dt_r(ctx):
    if ctx.n_train > MLLIB_ROWS:
        return _HistogramTrees(ctx, "tree", False)
    return DecisionTreeRegressor(maxDepth=ctx.cfg.max_depth, maxBins=ctx.cfg.max_bins, seed=ctx.cfg.seed,
                                 **_TREE_EXEC)


def _kernel_stages(ctx):
    """Shared SVM scaler (fitted on train) + RFF map with gamma = 1 / (d · Var X).

    The kernel depends on squared distances over that variance, so scaling by the
    sample or the population deviation gives the same kernel.
    """
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(ctx.train)
    s = scaler.transform(ctx.train).select(Summarizer.metrics("mean", "variance").summary(F.col("scaled")).alias("s"))
    r = s.first()["s"]
    means, variances = r["mean"].toArray(), r["variance"].toArray()
    n = max(ctx.n_train, 2)
    pop_var = variances * (n - 1) / n
    total_var = float((pop_var + means ** 2).mean() - means.mean() ** 2)
    gamma = 1.0 / (ctx.dim * total_var) if total_var > 0 else 1.0
    rff = RandomFourierFeatures(inputCol="scaled", outputCol="rff", numFeatures=ctx.cfg.rff_dim, inputDim=ctx.dim,
                                gamma=gamma, seed=ctx.cfg.seed)
    return scaler, rff


class _SvcOfManyClasses:
    """The kernel classifier of more than two classes beyond ``MLLIB_ROWS`` rows: all classes in the same passes."""

    def __init__(self, ctx):
        self.ctx = ctx

    def fit(self, train: DataFrame) -> PipelineModel:
        scaler, rff = _kernel_stages(self.ctx)
        gamma, dim, seed = rff.getOrDefault(rff.gamma), self.ctx.dim, self.ctx.cfg.seed
        found = fit_svc(scaler.transform(train), "scaled", "label", self.ctx.num_classes, dim, self.ctx.cfg.rff_dim, gamma, seed)
        head = KernelClassification(inputCol="scaled", outputCol="prediction", inputDim=dim, gamma=gamma, weights=found.weights.ravel().tolist(), intercepts=found.intercepts.tolist(), seed=seed)
        return PipelineModel(stages=[scaler, head])


def _svc(ctx):
    if ctx.num_classes > 2 and ctx.n_train > MLLIB_ROWS:
        return _SvcOfManyClasses(ctx)
    scaler, rff = _kernel_stages(ctx)
    svm = LinearSVC(featuresCol="rff", regParam=1.0 / max(ctx.n_train, 1), maxIter=100)
    head = svm if ctx.num_classes <= 2 else OneVsRest(classifier=svm, featuresCol="rff",
                                                      parallelism=_ovr_threads(ctx))
    return Pipeline(stages=[scaler, rff, head])


class _SvrOnFeatures:
    """Support vector regression on random features, C = 1 and ε = 0.1; ``svr_loss="huber"`` fits a robust
    regression on the standardised target instead.  The fitted pipeline needs no label column."""

    def __init__(self, ctx):
        self.ctx = ctx

    def fit(self, train: DataFrame) -> PipelineModel:
        scaler, rff = _kernel_stages(self.ctx)
        if self.ctx.cfg.svr_loss == "huber":
            return self.fit_huber(train, scaler, rff)
        gamma, dim, seed = rff.getOrDefault(rff.gamma), self.ctx.dim, self.ctx.cfg.seed
        found = fit_svr(scaler.transform(train), "scaled", "label", dim, self.ctx.cfg.rff_dim, gamma, seed)
        head = KernelRegression(inputCol="scaled", outputCol="prediction", inputDim=dim, gamma=gamma, weights=found.weights.tolist(), intercept=found.intercept, seed=seed)
        return PipelineModel(stages=[scaler, head])

    def fit_huber(self, train: DataFrame, scaler, rff) -> PipelineModel:
        lab = train.agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("s")).first()
        mu, sd = float(lab["m"]), float(lab["s"] or 1.0) or 1.0
        mapped = rff.transform(scaler.transform(train)).withColumn("label_std", (F.col("label") - mu) / sd)
        huber = LinearRegression(featuresCol="rff", labelCol="label_std", predictionCol="pred_std", loss="huber",
                                 epsilon=1.35, regParam=1.0 / max(self.ctx.n_train, 1), elasticNetParam=0.0,
                                 maxIter=100).fit(mapped)
        back = SQLTransformer(statement=f"SELECT *, pred_std * {sd!r} + {mu!r} AS prediction FROM __THIS__")
        return PipelineModel(stages=[scaler, rff, huber, back])


# fixed values: model names and order of the reference registry
REGISTRY: dict[str, list[tuple[str, Builder]]] = {
    "classification": [("LogisticRegression", _lr), ("RandomForest", _rf_c), ("GradientBoosting", _gb_c),
                       ("SVC_RFF", _svc), ("DecisionTree", _dt_c)],
    "regression": [("LinearRegression", _lin), ("RandomForest", _rf_r), ("GradientBoosting", _gb_r),
                   ("SVR_RFF", _SvrOnFeatures), ("DecisionTree", _dt_r)],
}


@dataclass
class CompareResult:
    family: str
    leaderboard: DataFrame
    best_model_name: str
    best_metrics: dict
    importance: DataFrame
    models: dict[str, object] = field(default_factory=dict)
    features: FeatureModel | None = None
    feature_names: list[str] = field(default_factory=list)
    skipped: dict[str, str] = field(default_factory=dict)
    over_budget: list[str] = field(default_factory=list)


def index_numeric_labels(encoded: DataFrame, label: str = "label") -> tuple[DataFrame, int]:
    """Map numeric class values to 0..k−1 (sorted) by a join with their distributed vocabulary."""
    values = dense_index(encoded.select(F.col(label).alias("__value")).distinct().orderBy("__value"), "__code")
    k = values.count()
    values = F.broadcast(values) if k <= BROADCAST_CODES else values  # 16 bytes a row
    coded = encoded.join(values, F.col(label) == F.col("__value")).withColumn(label, F.col("__code").cast("double"))
    return coded.drop("__value", "__code"), k


def with_class_count(encoded: DataFrame, k: int) -> DataFrame:
    """Tell MLlib the number of classes; otherwise trees refuse labels of 100 and more."""
    meta = {"ml_attr": {"type": "nominal", "name": "label", "num_vals": max(k, 2)}}
    return encoded.withColumn("label", F.col("label").alias("label", metadata=meta))


def native_importance(model, dim: int) -> list[float] | None:
    """Tree importances; |coefficients| for linear models (mean over classes); mean over one-vs-rest models."""
    import numpy as np

    if isinstance(model, PipelineModel):
        if len(model.stages) > 1:
            return None  # kernel pipelines (RFF): weights live in the random-feature space
        model = model.stages[0]
    m = model
    if hasattr(m, "models") and isinstance(getattr(m, "models", None), list):
        subs = [native_importance(s, dim) for s in m.models]
        subs = [s for s in subs if s is not None]
        return list(np.mean(np.array(subs), axis=0)) if subs else None
    if hasattr(m, "featureImportances"):
        return list(m.featureImportances.toArray())
    if hasattr(m, "coefficientMatrix") and getattr(m, "numClasses", 2) > 2:
        cm = m.coefficientMatrix.toArray()
        return list(np.mean(np.abs(cm), axis=0))
    if hasattr(m, "coefficients"):
        return list(np.abs(m.coefficients.toArray()))
    return None


def compare_models(df: DataFrame, cfg: TrainConfig) -> CompareResult:
    """Train and compare the registry for ``cfg.problem_type`` on ``df``."""
    check_config(df, cfg.target, cfg.problem_type, cfg.train_ratio)
    keys = list(cfg.split_keys or df.columns)
    if cfg.exact_split:
        marked = exact_split_flag(df, keys, cfg.train_ratio, cfg.seed, "__is_train")
    else:
        marked = df.withColumn("__is_train", split_flag(keys, cfg.train_ratio, cfg.seed))
    return _compare_marked(marked, cfg)


def cross_validate(df: DataFrame, cfg: TrainConfig, folds: int = 5) -> DataFrame:
    """k-fold scores per model: fold = md5 bucket mod k (reproducible, no shuffle to assign folds).

    Returns ``(model, model_idx, folds, mean_score, std_score)`` with accuracy or r2 as the score.
    """
    from tessera.functions.scalars import hash_bucket

    check_config(df, cfg.target, cfg.problem_type, 0.5)
    keys = list(cfg.split_keys or df.columns)
    fam = family(cfg.problem_type)
    score = "accuracy" if fam == "classification" else "r2"
    boards = []
    for k in range(folds):
        marked = df.withColumn("__is_train", F.pmod(hash_bucket(keys, cfg.seed), F.lit(folds)) != k)
        res = _compare_marked(marked, cfg, explain=False)
        boards.append(res.leaderboard.select("model", "model_idx", F.col(score).alias("score"), F.lit(k).alias("fold")))
    allb = boards[0]
    for b in boards[1:]:
        allb = allb.unionByName(b)
    return allb.groupBy("model", "model_idx").agg(F.count("score").alias("folds"), F.avg("score").alias("mean_score"),
                                                  F.stddev_samp("score").alias("std_score"))


class FitInterrupted(RuntimeError):
    """A fit took longer than its budget and its jobs were cancelled."""


def _fit(spark, estimator, train: DataFrame, cfg: TrainConfig):
    """The fitted model; with ``cfg.interrupt`` the fit's jobs carry a tag of their own, by which they are cancelled when its time is up.

    The fit then runs in a thread that inherits the session's tags, so that a cancelled
    job ends it; nothing else of the session is touched.
    """
    if not cfg.interrupt or cfg.timeout_seconds is None:
        return estimator.fit(train)
    tag, out = f"fit-{uuid.uuid4().hex}", {}

    def work() -> None:
        spark.addTag(tag)
        spark.sparkContext.addJobTag(tag)  # jobs below the Dataset interface, as the trees' own
        try:
            out["model"] = estimator.fit(train)
        except Exception as e:  # noqa: BLE001 - told to the caller below
            out["error"] = e
        finally:
            spark.removeTag(tag)
            spark.sparkContext.removeJobTag(tag)

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(cfg.timeout_seconds)
    if thread.is_alive():
        late = time.time()
        while thread.is_alive():  # a fit is many jobs: whichever it starts next is cancelled too
            spark.interruptTag(tag)
            spark.sparkContext.cancelJobsWithTag(tag)
            thread.join(0.2)
            if time.time() - late > 60:
                break
        if "model" not in out:
            raise FitInterrupted(f"cancelled after {cfg.timeout_seconds} s")
    if "error" in out:
        raise out["error"]
    return out["model"]


def _compare_marked(marked: DataFrame, cfg: TrainConfig, explain: bool = True) -> CompareResult:
    from tessera.operators.importance import permutation_importance

    fam = family(cfg.problem_type)
    spark = marked.sparkSession
    checkpoint_root(spark)  # tree node-id caches checkpoint into the shared folder
    fm = fit_features(marked.drop("__is_train"), cfg.target,
                      fit_rows=marked.where("__is_train").drop("__is_train") if cfg.fit_scope == "train" else None)
    names = fm.feature_names()
    keys = [k for k in (cfg.split_keys or marked.columns) if k != "__is_train"]
    hashed = marked.withColumn("__h", F.xxhash64(*[qcol(k) for k in keys]))
    enc = fm.transform(hashed, keep=["__is_train", "__h"]).where(F.col("label").isNotNull())
    num_classes = 0
    if fam == "classification":
        if fm.spec.target_kind == "numeric":
            enc, num_classes = index_numeric_labels(enc)
        else:
            num_classes = int(fm.spec.target_classes or 0)
        enc = with_class_count(enc, num_classes)
    # a row's partition and place follow from its key, so seeded fits give the same model on any cluster
    enc = enc.repartition(fit_partitions(marked.count()), "__h").sortWithinPartitions("__h").drop("__h")
    enc = enc.persist(StorageLevel.MEMORY_AND_DISK)
    train = enc.where("__is_train").drop("__is_train")
    test = enc.where("NOT __is_train").drop("__is_train")
    sides = enc.agg(F.count_if("__is_train").alias("train"), F.count_if(~F.col("__is_train")).alias("test")).first()
    n_train = sides["train"]
    if not n_train or not sides["test"]:
        enc.unpersist()
        raise ValueError(f"Empty split: {n_train} training and {sides['test']} test rows; use exact_split=True")
    ctx = FitContext(n_train, num_classes, len(names), cfg, train)
    over_budget: list[str] = []
    rows, models, skipped = [], {}, {}
    for idx, (name, build) in enumerate(REGISTRY[fam]):
        if cfg.models and name not in cfg.models:
            continue
        try:
            t0 = time.time()
            est = build(ctx)
            model = _fit(spark, est, train, cfg)
            elapsed = time.time() - t0
            if cfg.timeout_seconds is not None and elapsed > cfg.timeout_seconds:
                over_budget.append(name)
            pred = model.transform(test)
            try:
                if fam == "classification":
                    m = classification_metrics(pred).first().asDict()
                    row = (name, idx, m["accuracy"], m["precision"], m["recall"], m["f1"], None, None)
                else:
                    m = regression_metrics(pred).first().asDict()
                    row = (name, idx, None, None, None, None, m["mse"], m["r2"])
            except Exception as e:  # noqa: BLE001 - a failed metric keeps only the time
                skipped[f"{name}:metrics"] = str(e)[:200]
                row = (name, idx, None, None, None, None, None, None)
            rows.append(row + (round(elapsed, 3),))
            models[name] = model
        except Exception as e:  # noqa: BLE001 - one model's failure is skipped
            skipped[name] = f"{type(e).__name__}: {str(e)[:300]}"
    if not rows:
        enc.unpersist()
        raise RuntimeError(f"No models trained successfully: {skipped}")
    board = spark.createDataFrame(rows, LEADERBOARD_SCHEMA)
    score_i = 2 if fam == "classification" else 7
    best = max(rows, key=lambda r: (r[score_i] if r[score_i] is not None else float("-inf"), -r[1]))
    best_name = best[0]
    imp_rows = []
    for name, model in models.items():
        vals = native_importance(model, len(names))
        if vals is not None:
            imp_rows += [(name, f, float(v)) for f, v in zip(names, vals)]
    importance = spark.createDataFrame(imp_rows, "model string, feature string, importance double")
    if explain and not any(r[0] == best_name for r in imp_rows):
        perm = permutation_importance(models[best_name], test, names, fam, repeats=5, seed=cfg.seed)
        importance = importance.unionByName(perm.select(F.lit(best_name).alias("model"), "feature", "importance"))
    enc.unpersist()
    best_metrics = dict(zip(["model", "model_idx", "accuracy", "precision", "recall", "f1", "mse", "r2",
                             "training_time"], best))
    return CompareResult(fam, board, best_name, best_metrics, importance, models, fm, names, skipped, over_budget)
