"""Permutation importance as one distributed pass.

For every repeat r the test rows, indexed in hash order, are re-paired by an
affine permutation of their index, ``π(i) = (a·i + c) mod n`` with ``a`` coprime
to n (seeded per r) — a true permutation that needs no sort.  One equi-join on
``(r, index)`` brings each row the row it is paired with; the variants, one for
each feature, are built beside it without a shuffle, scored by a single
``transform`` and summed by ``groupBy(f, r)``.  Importance = mean over repeats of
(baseline score − permuted score); it does not depend on partitioning.
"""

from __future__ import annotations

import math
import random

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import classification_metrics, regression_metrics
from tessera.operators.sampling import dense_index


def _score(pred: DataFrame, fam: str, group: list[str]) -> DataFrame:
    if fam == "classification":
        # accuracy per group
        return pred.groupBy(*group).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score"))
    y, p = F.col("label"), F.col("prediction")
    a = pred.groupBy(*group).agg(F.sum((y - p) * (y - p)).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"))
    return a.select(*group, F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
                    .otherwise(1 - F.col("sse") / F.col("sst")).alias("score"))


def _affine(n: int, seed: int, r: int) -> tuple[int, int]:
    rng = random.Random(seed * 1_000_003 + r)
    if n <= 1:
        return 1, 0
    while True:
        a, c = rng.randrange(1, n), rng.randrange(0, n)
        if math.gcd(a, n) == 1 and (a, c) != (1, 0):  # that one would leave every row where it is
            return a, c


def permutation_importance(model, test: DataFrame, names: list[str], fam: str, repeats: int = 5,
                           seed: int = 42) -> DataFrame:
    spark = test.sparkSession
    base_pred = model.transform(test)
    base = (classification_metrics(base_pred).first()["accuracy"] if fam == "classification"
            else regression_metrics(base_pred).first()["r2"])
    rows = test.select(vector_to_array("features").alias("x"), F.col("label").cast("double"))
    indexed = dense_index(rows.orderBy(F.xxhash64("x", "label"), "x", "label"))  # equal rows are interchangeable
    n = indexed.count()
    steps = [(r, *_affine(n, seed, r)) for r in range(repeats)]
    turns = F.explode(F.array(*[
        F.struct(F.lit(r).alias("r"), F.lit(c).cast("long").alias("c"),
                 F.lit(pow(a, -1, n) if n > 1 else 0).cast("long").alias("ainv")) for r, a, c in steps])).alias("g")
    # row j goes to the row i with π(i) = j, i = a⁻¹·(j − c) mod n: one self-join of n rows a repeat, for all features
    dec = "decimal(38,0)"
    moved = indexed.select(F.col("idx").alias("j"), F.col("x").alias("v"), turns).select(
        F.col("g.r").alias("r"), "v",
        F.pmod((F.col("j") - F.col("g.c")).cast(dec) * F.col("g.ainv").cast(dec), F.lit(n).cast(dec)).cast("long").alias("idx"))
    target = indexed.select("idx", "label", "x", F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("r"))
    joined = target.join(moved, ["r", "idx"])
    each = joined.select("r", "label", "x", "v", F.explode(F.array(*[F.lit(f) for f in range(len(names))])).alias("f"))
    permuted = each.select(
        "f", "r", "label",
        array_to_vector(F.transform("x", lambda x, i: F.when(i == F.col("f"), F.col("v")[i]).otherwise(x))).alias(
            "features"))
    scores = _score(model.transform(permuted), fam, ["f", "r"])
    imp = scores.groupBy("f").agg(F.avg(F.lit(base) - F.col("score")).alias("importance"))
    feats = spark.createDataFrame(list(enumerate(names)), "f int, feature string")
    out = feats.join(F.broadcast(imp), "f", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias(
        "importance"))
    return out
