"""Exact quantiles (linear interpolation) without holding a column in one task.

1. one pass brackets each wanted rank between two approximate percentiles
   (``percentile_approx``, relative error 2e-5);
2. a second pass counts exactly what lies below and inside each bracket; a
   bracket that misses its ranks is opened to the whole column on that side;
3. only the values inside the brackets (about 4e-4 of the rows) are counted per
   value and ranked by a running sum.

Result: ``value = x[lo] + (x[hi] − x[lo]) · frac`` as pandas/DuckDB compute it.
Everything stays in built-in functions; the driver sees a few numbers a column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.types import normalized

# half-width of a bracket in ranks over n, and the sketch's accuracy (its error is 1 / ACCURACY)
HALF_WIDTH, ACCURACY = 2e-4, 50_000
SCHEMA = "column_idx int, prob_idx int, value double"


def exact_quantiles(df: DataFrame, columns: list[str], probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """``(column_idx, prob_idx, value)`` for each column in ``columns`` (positions in ``df``)."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    pos = {c: i for i, c in enumerate(df.columns)}
    if not columns:
        return spark.createDataFrame([], SCHEMA)
    values = df.select([normalized(c, types[c]).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    ends = [min(1.0, max(0.0, q + d)) for q in probs for d in (-HALF_WIDTH, HALF_WIDTH)]
    near = values.agg(*[F.count(f"x{i}").alias(f"n{i}") for i in range(len(columns))],
                      *[F.percentile_approx(f"x{i}", ends, ACCURACY).alias(f"p{i}") for i in range(len(columns))]).first()
    wanted = []  # (column, prob index, first rank, second rank, share of the second, lower end, upper end)
    for i in range(len(columns)):
        n = near[f"n{i}"]
        for k, q in enumerate(probs if n else ()):
            at = (n - 1) * q
            wanted.append((i, k, math.floor(at), math.ceil(at), at - math.floor(at), near[f"p{i}"][2 * k], near[f"p{i}"][2 * k + 1]))
    if not wanted:
        return spark.createDataFrame([], SCHEMA)
    counts = values.agg(*[e for j, w in enumerate(wanted) for e in (
        F.count_if(F.col(f"x{w[0]}") < w[5]).alias(f"b{j}"), F.count_if(F.col(f"x{w[0]}") <= w[6]).alias(f"u{j}"))]).first()
    cells, plan = [], []
    for j, (i, k, lo, hi, share, low, high) in enumerate(wanted):
        x, below = F.col(f"x{i}"), counts[f"b{j}"]
        inside = x.isNotNull()
        if below <= lo:
            inside = inside & (x >= low)
        else:
            below = 0
        if hi < counts[f"u{j}"]:
            inside = inside & (x <= high)
        cells.append(F.when(inside, F.struct(F.lit(j).alias("j"), x.alias("v"))))
        plan.append((j, pos[columns[i]], k, lo - below, hi - below, share))
    inner = values.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
    per_value = inner.groupBy("j", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("j").orderBy("v"))
    ranked = per_value.withColumn("upto", upto)
    targets = F.broadcast(spark.createDataFrame(plan, "j int, column_idx int, prob_idx int, lo long, hi long, share double"))
    both = ranked.join(targets, "j").groupBy("column_idx", "prob_idx", "share").agg(
        F.min(F.when(F.col("upto") > F.col("lo"), F.col("v"))).alias("v_lo"),
        F.min(F.when(F.col("upto") > F.col("hi"), F.col("v"))).alias("v_hi"))
    return both.select("column_idx", "prob_idx", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("share")).alias("value"))
