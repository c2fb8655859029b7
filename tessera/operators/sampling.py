"""Deterministic samples, previews and the train/test split.

All "first n" operators take an explicit order; all random ones use the md5
hash bucket of a row key and a seed, so results do not depend on
partitioning and the SQL oracle can reproduce them.  Limits run as
``TakeOrderedAndProject`` (per-partition top-n, then a merge of n·P rows) —
never a full sort or a global window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import hash_bucket
from tessera.functions.types import qcol, NUMERIC, column_class, normalized
from tessera.operators.keys import row_digest
from tessera.session import checkpoint_root


def _q(n: str) -> str:
    return "`" + n.replace("`", "``") + "`"


def sample_key(keys: list[str], seed: int = 42) -> Column:
    """Order key for seeded sampling: the 32-bit md5 head of ``key:seed``."""
    text = F.concat_ws(":", *[qcol(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def numeric_sample(df: DataFrame, keys: list[str] | None = None, n: int = 100, max_columns: int | None = None,
                   seed: int = 42) -> DataFrame:
    """≤ n non-missing values of each numeric column (histogram input), in hash order of the row.

    Without keys the hash is of the whole row, so no column's order biases the
    sample.  Bottom-k by threshold: one aggregate counts each column's present cells
    by eighths of a power of two of the hash (some 500 groups, whatever the data), which tells up to
    where every column has its n; a second scan keeps the few rows below that, and only their cells are ranked.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    nums = [f.name for f in df.schema.fields if column_class(f.dataType) == NUMERIC][:max_columns]
    if not nums:
        return df.sparkSession.createDataFrame([], "column_name string, rank int, value double")
    h = sample_key(keys, seed) if keys else F.xxhash64(*[qcol(c) for c in df.columns], F.lit(seed))
    ties = [f"__k{i}" for i in range(len(keys or []))]
    hashed = df.select(h.alias("h"), *[qcol(k).alias(t) for k, t in zip(keys or [], ties)], *[normalized(c, types[c]).cast("double").alias(f"v{i}") for i, c in enumerate(nums)])
    if not keys:
        hashed = hashed.withColumn("h", F.shiftrightunsigned("h", 2))  # from 0 on
    part = F.floor(F.log2(F.col("h") + 1) * 8).cast("int")
    upto = Window.orderBy("part")  # at most some 500 rows
    counts = hashed.groupBy(part.alias("part")).agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(nums))])
    counts = counts.select("part", *[F.sum(f"n{i}").over(upto).alias(f"n{i}") for i in range(len(nums))])
    cut = counts.agg(*[F.coalesce(F.min(F.when(F.col(f"n{i}") >= n, F.col("part"))), F.max("part")).alias(f"c{i}") for i in range(len(nums))]).first()
    last = max((c for c in cut if c is not None), default=None)
    if last is None:
        return df.sparkSession.createDataFrame([], "column_name string, rank int, value double")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(cut[i]).alias("cut"), F.col(f"v{i}").alias("value")) for i, c in enumerate(nums)]))
    stacked = hashed.withColumn("part", part).where(F.col("part") <= last).select("h", *ties, "part", cells.alias("cell")).where("cell.value IS NOT NULL AND part <= cell.cut")
    w = Window.partitionBy("column_name").orderBy("h", *ties, "value")
    return stacked.select("h", *ties, "cell.column_name", "cell.value").withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= n).select(
        "column_name", "rank", "value")


def preview(df: DataFrame, order_by: list[str] | None = None, n: int = 5) -> DataFrame:
    """First n rows in key order, every cell as text, missing → ''."""
    order_by = order_by or [df.columns[0]]
    types = {f.name: f.dataType for f in df.schema.fields}
    head = df.orderBy(*[qcol(k).asc_nulls_last() for k in order_by]).limit(n)
    return head.select([
        F.coalesce(normalized(c, types[c]).cast("string"), F.lit("")).alias(c) for c in df.columns
    ])


def split_flag(keys: list[str], train_ratio: float = 0.8, seed: int = 42) -> Column:
    """True for the training side: md5 bucket (of 10,000) below ``ratio × 10,000``."""
    cut = int(round(float(train_ratio) * 10000))
    if 0.0 < float(train_ratio) < 1.0:
        cut = min(9999, max(1, cut))  # a ratio short of 1 keeps a test side
    return hash_bucket(keys, seed) < F.lit(cut)


def exact_split_flag(df: DataFrame, keys: list[str], train_ratio: float = 0.8, seed: int = 42,
                     name: str = "__train") -> DataFrame:
    """Mark exactly ``ceil(n · (1 − ratio))`` rows as test (false): those whose keys' md5 comes first.

    Selection without a sort: a histogram of four hexadecimal digits (at most 65,536
    counts) finds the digits at which the test side is full, and only the rows that share them are
    counted by the next four, until the cut falls between two values.  Rows with one md5 are
    told by the digest of the whole row; rows alike in that too are copies, of
    which the right number goes to either side.
    """
    text = F.concat_ws(":", *[qcol(k).cast("string") for k in keys], F.lit(str(seed)))
    own = row_digest(df)
    digits = [F.md5(text), F.concat(*[F.lower(F.lpad(F.hex(own[c]), 16, "0")) for c in ("a", "b")])]
    prefix, n_test, level, left = "", None, 0, 0
    while level < 16:
        order = F.substring(digits[0], 1, 4 * (level + 1)) if level < 8 else F.concat(digits[0], F.substring(digits[1], 1, 4 * (level - 7)))
        here = df.select(order.alias("d"))
        found = {r["d"]: r["n"] for r in here.where(F.col("d").startswith(prefix)).groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
        if n_test is None:
            n = sum(found.values())
            n_test = left = math.ceil(round(n * (1.0 - float(train_ratio)), 9))
            if left <= 0 or left >= n:
                return df.withColumn(name, F.lit(left <= 0))
        level += 1
        for d in sorted(found):
            if found[d] > left:
                prefix = d
                break
            left -= found[d]
            if not left:  # the cut is behind d
                return df.withColumn(name, order > F.lit(d))
    whole = F.concat(*digits)
    copies = df.where(whole == prefix)
    several = copies.limit(1).withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(copies.count()))))
    return df.where(whole != prefix).withColumn(name, whole > prefix).unionByName(several.withColumn(name, F.col("__i") > left).drop("__i"))


def train_test_split(df: DataFrame, keys: list[str] | None = None, train_ratio: float = 0.8,
                     seed: int = 42, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Reproducible split by hash bucket (no shuffle, no dependence on partitioning).

    Without keys every column is hashed, so identical rows share a side.
    ``exact=True`` gives the test side exactly ``ceil(n · (1 − ratio))`` rows, the
    first ones in hash order; see :func:`exact_split_flag`.
    """
    keys = keys or list(df.columns)
    if exact:
        marked = exact_split_flag(df, keys, train_ratio, seed)
    else:
        marked = df.withColumn("__train", split_flag(keys, train_ratio, seed))
    return (marked.where("__train").drop("__train"), marked.where("NOT __train").drop("__train"))


def with_split(df: DataFrame, keys: list[str] | None = None, train_ratio: float = 0.8, seed: int = 42,
               name: str = "is_train") -> DataFrame:
    keys = keys or list(df.columns)
    return df.withColumn(name, split_flag(keys, train_ratio, seed))


def dense_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """Contiguous 0..n−1 row index in the frame's current order, JVM-side (no Python rows).

    ``monotonically_increasing_id`` packs (partition id, row number); the frame
    is checkpointed so those ids are fixed, per-partition counts (one row per
    partition) give offsets, and ``idx = offset + row number``.
    """
    checkpoint_root(df.sparkSession)
    ck = df.withColumn("__mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    pid = F.shiftright(F.col("__mid"), 33)
    counts = ck.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    out = ck.withColumn("__pid", pid).join(F.broadcast(offsets), "__pid")
    local = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, (F.col("__off") + local).cast("long")).drop("__mid", "__pid", "__off")
