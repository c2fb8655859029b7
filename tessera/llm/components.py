"""Connected components of a graph kept in DataFrames, by contraction.

Each round every node picks the least of itself and its neighbours, and edges
move to what their ends picked.  The first round compares ids, which ends at
once for stars around their smallest id; later ones compare hashes, so that
chains shrink by a constant share too.  When no edge is left the picks of the
rounds are composed, and each group is named by its smallest id.  Rounds are
written to the shared folder, so none is recomputed after a lost executor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every id in ``edges`` (a, b) but for loops, the smallest id reachable."""
    now = materialise(edges.where("a <> b").select("a", "b"), "components-edges")
    rounds: list[DataFrame] = []
    while not rounds or now.limit(1).count():

        def rank(node: str, first: bool = not rounds) -> Column:
            return F.struct((F.lit(0) if first else F.xxhash64(node)).alias("order"), F.col(node).alias("id"))

        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        pick = materialise(least.select(F.col("a").alias("id"), F.least("least", rank("a"))["id"].alias("pick")), "components-picks")
        rounds.append(pick)
        left, right = pick.toDF("a", "x"), pick.toDF("b", "y")
        moved = now.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        now = materialise(moved.distinct(), "components-edges")
    named = rounds[0]
    for pick in rounds[1:]:
        named = named.join(pick.toDF("pick", "next"), "pick", "left").select("id", F.coalesce("next", "pick").alias("pick"))
    smallest = named.groupBy("pick").agg(F.min("id").alias("component"))
    return named.join(smallest, "pick").select("id", "component")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of ``n`` nodes, from edges a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
