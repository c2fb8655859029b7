"""Pairwise-complete Pearson correlation via masked Gram partials, tile by tile.

Two passes over the data, each a plain distributed job:

1. column means (one ``agg``) — used only as a shift for numeric stability;
2. per partition (``mapInArrow``), for the shifted matrix X₀ (0 where
   missing) and the presence mask M, the partial sums ``N = MᵀM``, ``S = X₀ᵀM``,
   ``Q = (X₀²)ᵀM`` and ``P = X₀ᵀX₀``.  Columns are dealt into blocks of ``BLOCK``; a
   pair of blocks is a scan of its own that reads these columns only and holds six
   matrices of a block's size, so a task's memory does not grow with the number of columns.
   Sums leave a task as tiles of ``TILE`` × ``TILE`` cells, one binary row each, and are added tile after
   tile in a stream behind a shuffle by tile: no task holds more than one tile of others.

For the pair (i, j) over the rows where both are present:
``cov = P − S_ij·S_ji/N``, ``var_i = Q_ij − S_ij²/N``, ``var_j = Q_ji − S_ji²/N``
and ``r = cov / sqrt(var_i·var_j)`` (null when a variance is 0 or N < 2).
The whole pass costs O(n·k²) flops in BLAS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.types import NUMERIC, column_class, normalized

#: Columns of a block (a task holds six square matrices of it), of a tile, and rows multiplied at a time.
BLOCK, TILE, ROWS = 512, 128, 2048


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if column_class(f.dataType) == NUMERIC]


def block_partials(left: list[int], right: list[int], tile: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per partition: the tiles (a, b) of the sums over columns ``left`` × ``right`` (the batch's columns, ``left`` first).

    A tile's binary row holds N, S_ij, S_ji, Q_ij, Q_ji and P one behind the other.
    """
    same = left == right
    wide = len(left) if same else len(left) + len(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, len(left), len(right)))
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                x = np.empty((part.num_rows, wide))
                for c in range(wide):
                    x[:, c] = part.column(c).to_numpy(zero_copy_only=False)
                m = ~np.isnan(x)
                x[~m] = 0.0
                m = m.astype("float64")
                xi, mi = x[:, : len(left)], m[:, : len(left)]
                xj, mj = (xi, mi) if same else (x[:, len(left) :], m[:, len(left) :])
                for at, (u, v) in enumerate(((mi, mj), (xi, mj), (mi, xj), (xi * xi, mj), (mi, xj * xj), (xi, xj))):
                    held[at] += u.T @ v
        for i in range(0, len(left), tile):
            for j in range(0, len(right), tile):
                cells = np.ascontiguousarray(held[:, i : i + tile, j : j + tile])
                yield pa.RecordBatch.from_arrays([pa.array([left[i]], pa.int32()), pa.array([right[j]], pa.int32()), pa.array([cells.shape[1]], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["a", "b", "height", "sums"])

    return run


def add_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile -> the cells of each tile, added up; one tile is held."""
    key, total = None, None

    def cells() -> pa.RecordBatch:
        grid = total.reshape(6, key[2], -1)
        i, j = np.meshgrid(np.arange(grid.shape[1]) + key[0], np.arange(grid.shape[2]) + key[1], indexing="ij")
        return pa.RecordBatch.from_arrays([pa.array(i.ravel().astype("int32")), pa.array(j.ravel().astype("int32")), *[pa.array(g.ravel()) for g in grid]], names=["i", "j", "n", "s_ij", "s_ji", "q_ij", "q_ji", "p"])

    for batch in batches:
        for a, b, height, sums in zip(*(batch.column(c) for c in ("a", "b", "height", "sums")), strict=True):
            own = (a.as_py(), b.as_py(), height.as_py())
            if own != key:
                if key:
                    yield cells()
                key, total = own, np.frombuffer(sums.as_buffer()).copy()
            else:
                total += np.frombuffer(sums.as_buffer())
    if key:
        yield cells()


def correlation_matrix(df: DataFrame, max_cols: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Long correlation table ``(i, col_i, j, col_j, corr, truncated)`` over the numeric columns.

    ``max_cols`` keeps the first so many and sets ``truncated``.  Infinite cells are
    left out of a pair like missing ones.

    Empty when fewer than two numeric columns exist (as the reference returns ``{}``).
    """
    spark = df.sparkSession
    schema = "i int, col_i string, j int, col_j string, corr double, truncated boolean"
    nums = numeric_columns(df) if columns is None else list(columns)
    if len(nums) < 2:
        return spark.createDataFrame([], schema)
    truncated = max_cols is not None and len(nums) > max_cols
    cols = nums[:max_cols]
    k = len(cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    values = [normalized(c, types[c]).cast("double") for c in cols]
    vals = df.select([F.when(F.abs(v) < F.lit(float("inf")), v).alias(f"x{i}") for i, v in enumerate(values)])
    means = vals.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(k)]).first()
    shifted = vals.select([
        (F.col(f"x{i}") - F.lit(float(means[i]) if means[i] is not None else 0.0)).alias(f"x{i}")
        for i in range(k)
    ])
    blocks = [list(range(start, min(start + BLOCK, k))) for start in range(0, k, BLOCK)]
    partials = None
    for at, left in enumerate(blocks):
        for right in blocks[at:]:
            read = shifted.select([f"x{c}" for c in (left if left == right else left + right)])
            part = read.mapInArrow(block_partials(left, right, TILE, ROWS), "a int, b int, height int, sums binary")
            partials = part if partials is None else partials.unionByName(part)
    pair = partials.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(
        add_tiles, "i int, j int, n double, s_ij double, s_ji double, q_ij double, q_ji double, p double")
    if len(blocks) > 1:  # a pair of different blocks is summed once; the cells below the diagonal are its mirror
        lower = F.floor(F.col("i") / BLOCK) != F.floor(F.col("j") / BLOCK)
        both = F.array(F.struct(*[F.col(c) for c in pair.columns]), F.struct(*[F.col(c).alias(o) for c, o in (("j", "i"), ("i", "j"), ("n", "n"), ("s_ji", "s_ij"), ("s_ij", "s_ji"), ("q_ji", "q_ij"), ("q_ij", "q_ji"), ("p", "p"))]))
        pair = pair.select(F.explode(F.when(lower, both).otherwise(F.slice(both, 1, 1))).alias("cell")).select("cell.*")
    n = F.col("n")
    cov = F.col("p") - F.try_divide(F.col("s_ij") * F.col("s_ji"), n)
    var_i = F.col("q_ij") - F.try_divide(F.col("s_ij") * F.col("s_ij"), n)
    var_j = F.col("q_ji") - F.try_divide(F.col("s_ji") * F.col("s_ji"), n)
    denom = F.sqrt(var_i * var_j)
    # clamp inside the condition: least/greatest skip nulls, and undefined must stay null
    r = F.when((n >= 2) & (var_i > 0) & (var_j > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / denom)))
    names = F.array(*[F.lit(c) for c in cols])
    return pair.select(
        F.col("i"), F.element_at(names, F.col("i") + 1).alias("col_i"),
        F.col("j"), F.element_at(names, F.col("j") + 1).alias("col_j"),
        r.alias("corr"), F.lit(truncated).alias("truncated"),
    )
