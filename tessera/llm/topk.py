"""Exact top-k search by distributed histogram selection.

All scores of a query set against all rows are computed block by block.  For
each query a global histogram of its scores finds the bin that holds the k-th
best; the next pass scores again and splits only that bin, until it is one
score wide.  What reaches that score is then kept, ties cut by the smaller id.
A pass returns counts, never scores, and a block counts no bin below its own
k-th best (the global k-th is at least as high), so what is shuffled is at most
k counts a query and block.

Defined cases: vectors that are null, empty or hold null or non-finite
components, and rows without an id, take no part; vectors of different lengths
are compared as if the shorter ended in zeros; rows that repeat a query's id
are that query's own and no candidates of it; if a query's id comes with
different vectors, the smallest (as an array) is asked; other repeated rows are
candidates each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import materialise

#: Rows in a block of candidates and of queries; bins of a histogram.
CANDIDATE_BLOCK, QUERY_BLOCK, BINS = 4096, 512, 1024


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True))


def pack(part: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """(id, vector) as rows (ids, dim, matrix) of up to ``size`` vectors, short ones ending in zeros."""
    for start in range(0, len(part), size):
        ids, vectors = part["id"].to_numpy()[start : start + size], part["vector"].to_list()[start : start + size]
        dim = max(map(len, vectors))
        matrix = np.zeros((len(vectors), dim), np.int64)
        for row, vector in zip(matrix, vectors, strict=True):
            row[: len(vector)] = vector
        yield pd.DataFrame({"ids": [ids.astype(np.int64).tobytes()], "dim": [dim], "matrix": [matrix.tobytes()]})


def unpack(ids: bytes, dim: int, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.int64).reshape(-1, dim)


def inner(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; through floating point where every partial sum is exact there."""
    dim = min(queries.shape[1], rows.shape[1])
    queries, rows = queries[:, :dim], rows[:, :dim]
    if float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * dim < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def scored(batches: Iterator[pd.DataFrame]):
    """(query ids, lower and upper bounds, candidate ids, scores, whether another row) of each pair of blocks."""
    for part in batches:
        for r in part.itertuples(index=False):
            query_ids, queries = unpack(r.q_ids, r.q_dim, r.q_matrix)
            ids, rows = unpack(r.ids, r.dim, r.matrix)
            state = {s["id"]: s for s in r.bounds}
            asked = [i for i, q in enumerate(query_ids.tolist()) if q in state]
            if asked:
                lo = np.array([state[query_ids[i]]["lo"] for i in asked], np.int64)
                hi = np.array([state[query_ids[i]]["hi"] for i in asked], np.int64)
                yield query_ids[asked], lo, hi, ids, inner(queries[asked], rows), query_ids[asked][:, None] != ids[None, :]


def pairs(candidates: DataFrame, queries: DataFrame, state: DataFrame, n_blocks: int) -> DataFrame:
    """Every block of candidates beside every block of queries that still asks, joined on the query block's number."""
    bounds = state.groupBy("block").agg(F.collect_list(F.struct("id", "lo", "hi")).alias("bounds"))
    asking = queries.join(bounds, "block")
    return candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(asking, "block")


def refine(found: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """Bounds of the k-th best score of each query, narrowed to one bin of its histogram.

    ``above``: candidates known to score more than ``hi``.  A query with fewer
    than k candidates in all keeps every one: its bounds close at the lower end.
    """

    def bars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for query_ids, lo, hi, _, scores, other in scored(batches):
            width = (hi - lo) // BINS + 1
            inside = other & (scores >= lo[:, None]) & (scores <= hi[:, None])
            bins = np.where(inside, (scores - lo[:, None]) // width[:, None], -1)
            for q, row in zip(query_ids, bins, strict=True):
                bin_, n = np.unique(row[row >= 0], return_counts=True)
                first = max(0, len(n) - np.searchsorted(np.cumsum(n[::-1]), k) - 1)
                yield pd.DataFrame({"id": q, "bin": bin_[first:], "n": n[first:]})

    counts = found.mapInPandas(bars, "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("id").orderBy(F.col("bin").desc())
    crossing = counts.withColumn("upto", F.sum("n").over(down)).join(state.select("id", "above"), "id").where(F.col("above") + F.col("upto") >= k)
    last = crossing.groupBy("id").agg(F.max(F.struct("bin", "upto", "n")).alias("b"))
    width = F.floor((F.col("hi") - F.col("lo")) / BINS) + 1
    low = F.col("lo") + F.col("b.bin") * width
    return state.join(last, "id", "left").select(
        "block", "id",
        F.when(F.col("b").isNull(), F.col("lo")).otherwise(low).cast("long").alias("lo"),
        F.when(F.col("b").isNull(), F.col("lo")).otherwise(F.least("hi", low + width - 1)).cast("long").alias("hi"),
        (F.col("above") + F.coalesce(F.col("b.upto") - F.col("b.n"), F.lit(0))).alias("above"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k best rows of each query by integer inner product.

    ``rows`` and ``queries`` have (id long, vector array<long>).
    """
    spark = rows.sparkSession
    asked = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    n_queries, top = asked.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))).first()
    longest = rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))).first()[0]
    if not n_queries or longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_blocks = -(-n_queries // QUERY_BLOCK)

    def block_up(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        (row,) = pack(part, len(part))
        return row.rename(columns=lambda c: f"q_{c}").assign(block=key[0])[["block", "q_ids", "q_dim", "q_matrix"]]

    numbered = materialise(asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block")).applyInPandas(block_up, "block int, q_ids binary, q_dim int, q_matrix binary"), "topk-queries")

    def pack_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield from pack(part, CANDIDATE_BLOCK)

    candidates = materialise(rows.select("id", "vector").mapInPandas(pack_all, "ids binary, dim int, matrix binary"), "topk-candidates")
    bound = int(min(top * longest * 1.000001 + 1, 2.0**62))

    def ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for block, ids in zip(part["block"], part["q_ids"], strict=True):
                yield pd.DataFrame({"block": block, "id": np.frombuffer(ids, np.int64)})

    state = numbered.select("block", "q_ids").mapInPandas(ids_of, "block int, id long").select("block", "id", F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"), F.lit(0).cast("long").alias("above"))
    state = materialise(state, "topk-state")
    while state.where("lo < hi").limit(1).count():
        still = state.where("lo < hi")
        state = materialise(state.where("lo = hi").unionByName(refine(pairs(candidates, numbered, still, n_blocks), still, k)), "topk-state")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for query_ids, lo, _, ids, scores, other in scored(batches):
            for q, least, row, mine in zip(query_ids, lo, scores, other, strict=True):
                at = np.flatnonzero(mine & (row >= least))
                at = at[np.lexsort((ids[at], -row[at]))][:k]
                yield pd.DataFrame({"query_id": q, "vec_id": ids[at], "score": row[at]})

    kept = pairs(candidates, numbered, state, n_blocks).mapInPandas(keep, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Ten best of all ``embeddings`` for every vec_id divisible by 100, by integer inner product."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    whole = table.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("vector"))
    return top_k(whole, whole.where(F.col("id") % 100 == 0))


OP10_SQL = """
WITH cells AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id IS NOT NULL),
v AS (
  SELECT vec_id, list(floor(1024 * CAST(x AS DOUBLE)) ORDER BY i) AS x FROM cells
  GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""
