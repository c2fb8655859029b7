"""Histogram trees for training tables beyond ``models.MLLIB_ROWS`` rows: deep forests and boosted trees.

MLlib sends a full histogram for every open node of every tree, however few rows the
node holds, and keeps all nodes as objects on the driver; one-vs-rest boosting runs its
jobs class by class.  Here, with the same bins, gains, bagging and stopping rules:

* ``fit_forest`` — rows become blocks of bin numbers once.  Nodes over ``SHARD_ROWS`` rows
  are split by histograms that are summed by (tree, node); only the chosen splits come
  to the driver.  A node below that is a shard: its rows are sent to one task, which
  grows it to the end.  Shards stay a table; scoring meets them by (tree, shard).
* ``fit_boosted`` — one job a level for all classes together; margins are kept beside the
  rows and brought up to date every ``KEEP`` iterations.

Bounds come from a sample of 10,000 rows (all rows of a smaller table), as in MLlib.
Bag weights are Poisson(1) by seed, tree and block; blocks follow from the training
table's partitions.  Numbers are rounded to a unit at which every sum is exact, so the
result does not depend on the order of summing.  Split ties go to the first feature and
the lowest bound.  Large forests score batches, not streams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialise, scratch_path

SHARD_ROWS = 1 << 17  # most bagged rows that one task grows a subtree from
BATCH_CELLS = 1 << 27  # rows × trees sent to shards at once
TASK_ROWS = 1 << 14  # rows a task holds in blocks
GROWN_ROWS = 1 << 20  # bagged rows of all shards that a task grows, about
KEEP = 10  # boosting iterations between two refreshes of the margins
SAMPLE = 10_000  # rows that bounds are chosen from
FEW_NODES = 31  # nodes of a tree up to which all rows take all its tests
DIRECT_CELLS = 1 << 22  # cells of all tasks' histograms that the driver adds up itself
LEAF, SHARD = -1, -2
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}

Stats = list[np.ndarray]


# ------------------------------------------------------------------ bins
def bounds_of(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` − 1 bounds: between all neighbours if they are few, else by equal counts."""
    seen, counts = np.unique(values, return_counts=True)
    if len(seen) <= bins:
        return (seen[:-1] + seen[1:]) / 2
    stride, found, aim = counts.sum() / bins, [], counts.sum() / bins
    below = np.cumsum(counts)
    for i in range(1, len(seen)):
        if abs(below[i - 1] - aim) < abs(below[i] - aim):
            found.append((seen[i - 1] + seen[i]) / 2)
            aim += stride
    return np.array(found[: bins - 1])


def feature_bounds(train: DataFrame, dim: int, n_rows: int, bins: int, seed: int) -> list[np.ndarray]:
    some = train if n_rows <= SAMPLE else train.sample(False, SAMPLE / n_rows, seed)
    cells = some.select(F.posexplode(vector_to_array("features")).alias("at", "x"))

    def choose(cells: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": cells["at"][:1], "bounds": [bounds_of(cells["x"].to_numpy(), bins)]})

    rows = cells.groupBy("at").applyInPandas(choose, "at int, bounds array<double>").collect()
    found = {r["at"]: np.array(r["bounds"], float) for r in rows}
    return [found.get(f, np.zeros(0)) for f in range(dim)]


def to_codes(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: how many bounds are below the value."""
    kind = np.uint8 if max(map(len, bounds), default=0) < 256 else np.uint16
    out = np.empty((len(x), len(bounds)), kind)
    for f, b in enumerate(bounds):
        out[:, f] = np.searchsorted(b, x[:, f], side="left")
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = pa.schema([(name, ARROW[kind]) for name, kind in (column.split() for column in schema.split(", "))])
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


BLOCK = "part int, seq int, codes binary, label binary, margin binary"


def to_blocks(train: DataFrame, bounds: list[np.ndarray], n_rows: int, centre: float, unit: float, margins: int) -> DataFrame:
    """The rows as blocks of bin numbers and labels; labels less ``centre``, in whole units."""
    dim = len(bounds)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, b in enumerate(batches):
            y = np.asarray(b.column("label")) - centre
            y = np.round(y / unit) * unit
            codes = to_codes(matrix(b.column("x"), dim), bounds)
            yield batch(BLOCK, [(TaskContext.get().partitionId(), seq, packed(codes), packed(y), bytes(8 * margins * len(y)))])

    rows = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    tasks = max(1, math.ceil(n_rows / TASK_ROWS))
    blocks = rows.mapInArrow(pack, BLOCK)
    # boosting asks for as many rows a task, and its sums do not depend on which; a forest's bags follow from the blocks' numbers
    if margins and train.rdd.getNumPartitions() >= tasks:
        blocks = blocks.coalesce(tasks)
    else:
        blocks = blocks.repartition(tasks, "part", "seq").sortWithinPartitions("part", "seq")
    return materialise(blocks, "tree_blocks").persist(StorageLevel.MEMORY_AND_DISK)  # the plans of hundreds of jobs stay short


class Layout:
    """Where each feature's bins lie in a histogram."""

    def __init__(self, bounds: list[np.ndarray]):
        self.bins = np.array([len(b) + 1 for b in bounds])
        self.start = np.concatenate([[0], np.cumsum(self.bins)])
        self.total = int(self.start[-1])
        self.dim = len(bounds)
        self.kind = np.uint8 if self.bins.max(initial=1) <= 256 else np.uint16
        self.feature = np.repeat(np.arange(self.dim), self.bins)
        self.code = np.arange(self.total) - self.start[self.feature]

    def codes(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.dim)


# ------------------------------------------------------------------ splits
def score(stats: Stats, classes: int) -> np.ndarray:
    """What a node explains: Σ count² / rows for classes, sum² / rows for numbers (empty: 0)."""
    weight, top = (sum(stats), sum(s * s for s in stats)) if classes else (stats[0], stats[1] * stats[1])
    return np.divide(top, weight, out=np.zeros(len(weight)), where=weight > 0)


def best_cuts(segment: np.ndarray, code: np.ndarray, stats: Stats, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Stats]:
    """The best cut of every segment that has one: its number, gain, last code on the left and the left sums.

    Rows are in the order of (segment, code); a row may stand for many.
    """
    none = np.zeros(0, int)
    first = np.concatenate([[True], segment[1:] != segment[:-1]]) if len(segment) else none
    cut = np.flatnonzero(~first[1:] & (code[1:] != code[:-1])) if len(segment) else none
    if not len(cut):
        return none, np.zeros(0), none, [np.zeros(0) for _ in stats]
    starts = np.flatnonzero(first)
    ends = np.concatenate([starts[1:], [len(segment)]]) - 1
    at = (np.cumsum(first) - 1)[cut]
    left, right, whole = [], [], []
    for s in stats:
        run = np.cumsum(s)
        before = run[starts] - s[starts]
        total = run[ends] - before
        left.append(run[cut] - before[at])
        right.append(total[at] - left[-1])
        whole.append(total)
    both = (sum(left) > 0) & (sum(right) > 0) if classes else (left[0] > 0) & (right[0] > 0)
    gain = np.where(both, score(left, classes) + score(right, classes) - score(whole, classes)[at], 0.0)
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    most = np.maximum.reduceat(gain, heads)
    hit = np.flatnonzero(gain == np.repeat(most, np.diff(np.concatenate([heads, [len(at)]]))))
    hit = hit[np.concatenate([[True], at[hit][1:] != at[hit][:-1]])]
    return segment[cut[hit]], most, code[cut[hit]], [x[hit] for x in left]


def best_of_histogram(hist: np.ndarray, layout: Layout, classes: int, some: np.ndarray | None = None) -> tuple[float, int, int, np.ndarray]:
    """Gain, feature, code and left sums of one node's best split; ``hist`` is (bins, sums); feature −1 if there is none."""
    keep = np.ones(layout.total, bool) if some is None else np.isin(layout.feature, some)
    keep &= (hist[:, : classes or 1].sum(axis=1)) > 0
    found, gain, code, left = best_cuts(layout.feature[keep], layout.code[keep], list(hist[keep].T), classes)
    if not len(gain) or gain.max() <= 0:
        return 0.0, LEAF, 0, np.zeros(hist.shape[1])
    i = int(np.argmax(gain))
    return float(gain[i]), int(found[i]), int(code[i]), np.array([s[i] for s in left])


def unexplained(total: Stats, squares: np.ndarray | None, classes: int) -> np.ndarray:
    """Impurity × rows; 0 for a pure node."""
    all_ = sum(total) if classes else squares
    rest = all_ - score(total, classes)
    return np.where(rest > 1e-12 * all_, rest, 0.0)


def picks(rng: np.random.Generator, nodes: int, dim: int, wanted: int) -> np.ndarray:
    """``wanted`` different features for every node."""
    out = np.empty((nodes, wanted), np.int32)
    for a in range(0, nodes, 4096):
        b = min(a + 4096, nodes)
        out[a:b] = np.argpartition(rng.random((b - a, dim)), wanted - 1, axis=1)[:, :wanted]
    return out


# ------------------------------------------------------------------ one task's subtree
def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, bins: np.ndarray, classes: int, depth: int,
         rng: np.random.Generator, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut, left child and value of every node (the right child follows the left), and the gains by feature."""
    dim = codes.shape[1]
    columns = np.ascontiguousarray(codes.T)
    rows, node, nodes, done = np.arange(len(y)), np.zeros(len(y), np.int64), 1, 0
    y_class = y.astype(np.int64) if classes else None
    feature, cut, left, value, gains = [], [], [], [], np.zeros(dim)
    for level in range(depth + 1):
        wr = w[rows].astype(float)
        if classes:
            total = list(np.bincount(node * classes + y_class[rows], wr, nodes * classes).reshape(nodes, classes).T)
            value.append(np.column_stack(total))
            rest = unexplained(total, None, classes)
        else:
            yr = y[rows]
            total = [np.bincount(node, wr, nodes), np.bincount(node, wr * yr, nodes)]
            value.append((total[1] / total[0])[:, None])
            rest = unexplained(total, np.bincount(node, wr * yr * yr, nodes), 0)
        best, which, code = np.zeros(nodes), np.full(nodes, LEAF, np.int32), np.zeros(nodes, np.int64)
        if level < depth and rest.any():
            live = (rest > 0)[node]
            rows, node, wr = rows[live], node[live], wr[live]
            stats = [np.where(y_class[rows] == c, wr, 0.0) for c in range(classes)] if classes else [wr, wr * y[rows]]
            chosen = picks(rng, nodes, dim, wanted) if wanted < dim else None
            for f in np.flatnonzero(bins > 1):
                at = slice(None) if chosen is None else np.flatnonzero((chosen == f).any(axis=1)[node])
                of, c = node[at], columns[f][rows[at]]
                shift = max(1, int(len(of)).bit_length())
                order = np.sort(((of * int(bins[f]) + c) << shift) | np.arange(len(of))) & ((1 << shift) - 1)
                seg, gain, last, _ = best_cuts(of[order], c[order], [s[at][order] for s in stats], classes)
                up = gain > best[seg]
                best[seg[up]], which[seg[up]], code[seg[up]] = gain[up], f, last[up]
        split = best > 1e-9 * rest
        split &= best > 0
        which[~split] = LEAF
        np.add.at(gains, which[split], best[split])
        child = np.zeros(nodes, np.int32)
        child[split] = done + nodes + 2 * np.arange(split.sum())
        feature.append(which)
        cut.append(code)
        left.append(child)
        done += nodes
        if not split.any():
            break
        live = split[node]
        rows, node = rows[live], node[live]
        right = columns[which[node], rows] > code[node]
        node, nodes = 2 * (np.cumsum(split) - 1)[node] + right, 2 * int(split.sum())
    return np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(value), gains


def descend(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The node without children that every row comes to."""
    at, live = np.zeros(len(codes), np.int64), np.arange(len(codes))
    while len(live):
        live = live[feature[at[live]] >= 0]
        here = at[live]
        at[live] = left[here] + (codes[live, feature[here]] > cut[here])
    return at


def settle(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """As ``descend``, quicker for the few levels of a boosted tree: rows at a leaf step in place."""
    leaf = feature < 0
    which, last, to = np.where(leaf, 0, feature), np.where(leaf, 1 << 20, cut), np.where(leaf, np.arange(len(feature)), left)
    flat, base, at = codes.ravel(), np.arange(len(codes)) * codes.shape[1], np.zeros(len(codes), np.int64)
    while not leaf[at].all():
        at = to[at] + (flat[base + which[at]] > last[at])
    return at


# ------------------------------------------------------------------ forests
class Top:
    """The part of a tree above its shards."""

    def __init__(self, width: int):
        self.feature, self.cut, self.left, self.depth = [SHARD], [0], [0], [0]
        self.value: list[np.ndarray] = [np.zeros(width)]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left)


def bag(seed: int, tree: int, part: int, seq: int, n: int, bagged: bool) -> np.ndarray:
    return np.random.default_rng([seed, tree, part, seq]).poisson(1.0, n).astype(np.uint8) if bagged else np.ones(n, np.uint8)


SPLIT = "tree int, node int, weight double, feature int, cut int, gain double, value binary, sides binary"
ROWS = "tree int, node int, part int, seq int, codes binary, label binary, weight binary"
TREE = "tree int, node int, feature binary, cut binary, left binary, value binary, gains binary"


def _open_splits(blocks: DataFrame, tops: dict[int, Top], open_: dict[int, list[int]], layout: Layout, classes: int, seed: int, bagged: bool, wanted: int) -> list:
    """The best split of every open node, from histograms summed by (tree, node)."""
    arrays = {t: tops[t].arrays() for t in open_}
    width = classes or 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        squares: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                codes, y = layout.codes(r["codes"]), np.frombuffer(r["label"])
                for t, nodes in open_.items():
                    place = np.full(len(arrays[t][0]), -1)
                    place[nodes] = np.arange(len(nodes))
                    at = place[descend(*arrays[t], codes)]
                    w = bag(seed, t, r["part"], r["seq"], len(y), bagged)
                    rows = np.flatnonzero((at >= 0) & (w > 0))
                    at, wr, yr = at[rows], w[rows].astype(float), y[rows]
                    if t not in sums:
                        sums[t], squares[t] = np.zeros((len(nodes), layout.total, width)), np.zeros(len(nodes))
                    squares[t] += np.bincount(at, wr * yr * yr, len(nodes))
                    for f in range(layout.dim):
                        key, m, s = at * layout.bins[f] + codes[rows, f], int(layout.bins[f]), slice(layout.start[f], layout.start[f + 1])
                        if classes:
                            sums[t][:, s] += np.bincount(key * classes + yr.astype(int), wr, len(nodes) * m * classes).reshape(len(nodes), m, classes)
                        else:
                            sums[t][:, s, 0] += np.bincount(key, wr, len(nodes) * m).reshape(-1, m)
                            sums[t][:, s, 1] += np.bincount(key, wr * yr, len(nodes) * m).reshape(-1, m)
        for t, nodes in open_.items():
            if t in sums:
                yield batch("tree int, node int, hist binary", [(t, n, packed(np.append(sums[t][i].ravel(), squares[t][i]))) for i, n in enumerate(nodes)])

    def choose(table: pa.Table) -> pa.Table:
        t, n = table["tree"][0].as_py(), table["node"][0].as_py()
        flat = sum(np.frombuffer(h.as_py()) for h in table["hist"])
        hist = flat[:-1].reshape(layout.total, width)
        whole = hist[: layout.bins[0]].sum(axis=0)
        rest = unexplained([whole[i : i + 1] for i in range(width)], flat[-1:], classes)[0]
        some = picks(np.random.default_rng([seed, t, n, 1 << 20]), 1, layout.dim, wanted)[0] if wanted < layout.dim else None
        gain, feature, cut, left = best_of_histogram(hist, layout, classes, some)
        if rest <= 0 or gain <= 1e-9 * rest:
            feature = LEAF
        weight = whole.sum() if classes else whole[0]
        return pa.Table.from_batches([batch(SPLIT, [(t, n, float(weight), feature, cut, gain, packed(whole), packed(np.concatenate([left, whole - left])))])])

    return blocks.mapInArrow(count, "tree int, node int, hist binary").groupBy("tree", "node").applyInArrow(choose, SPLIT).collect()


def _grow_tops(blocks: DataFrame, trees: range, layout: Layout, classes: int, depth: int, seed: int, bagged: bool, wanted: int, n_rows: int) -> tuple[dict[int, Top], np.ndarray]:
    """Splits nodes until each has at most ``SHARD_ROWS`` rows; also the gains by (tree, feature)."""
    width = classes or 1
    tops, gains = {t: Top(width) for t in trees}, np.zeros((len(trees), layout.dim))
    # bag weights make a tree's root a little heavier or lighter than n_rows
    open_ = {t: [0] for t in trees} if n_rows > SHARD_ROWS * 0.9 else {}
    while open_:
        found, then = _open_splits(blocks, tops, open_, layout, classes, seed, bagged, wanted), {}
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            t, n = r["tree"], r["node"]
            top, whole = tops[t], np.frombuffer(r["value"])
            if r["weight"] <= SHARD_ROWS:
                continue
            if r["feature"] == LEAF or top.depth[n] >= depth:
                top.feature[n], top.value[n] = LEAF, whole if classes else whole[1:2] / whole[0]
                continue
            top.feature[n], top.cut[n], top.left[n] = r["feature"], r["cut"], len(top.feature)
            gains[t - trees.start, r["feature"]] += r["gain"]
            for side in np.frombuffer(r["sides"]).reshape(2, -1):
                if (side.sum() if classes else side[0]) > SHARD_ROWS:
                    then.setdefault(t, []).append(len(top.feature))
                top.feature.append(SHARD)
                top.cut.append(0)
                top.left.append(0)
                top.depth.append(top.depth[n] + 1)
                top.value.append(np.zeros(width))
        open_ = then
    return tops, gains


def _shards(blocks: DataFrame, tops: dict[int, Top], layout: Layout, classes: int, depth: int, seed: int, bagged: bool, wanted: int, n_rows: int) -> DataFrame:
    """Rows sent to their shards, where one task grows each to the end."""
    arrays = {t: top.arrays() for t, top in tops.items()}
    deep = {t: top.depth for t, top in tops.items()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                codes, y = layout.codes(r["codes"]), np.frombuffer(r["label"])
                for t, (feature, cut, left) in arrays.items():
                    w = bag(seed, t, r["part"], r["seq"], len(y), bagged)
                    rows = np.flatnonzero(w > 0)
                    at, out = descend(feature, cut, left, codes[rows]), []
                    for n in np.flatnonzero(feature == SHARD):
                        mine = rows[at == n]
                        if len(mine):
                            out.append((t, int(n), r["part"], r["seq"], packed(codes[mine]), packed(y[mine]), packed(w[mine])))
                    if out:
                        yield batch(ROWS, out)

    def finish(table: pa.Table) -> pa.Table:
        t, n = table["tree"][0].as_py(), table["node"][0].as_py()
        table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
        codes = np.concatenate([layout.codes(c.as_py()) for c in table["codes"]])
        y = np.concatenate([np.frombuffer(c.as_py()) for c in table["label"]])
        w = np.concatenate([np.frombuffer(c.as_py(), np.uint8) for c in table["weight"]])
        feature, cut, left, value, gains = grow(codes, y, w, layout.bins, classes, depth - deep[t][n], np.random.default_rng([seed, t, n]), wanted)
        return pa.Table.from_batches([batch(TREE, [(t, n, packed(feature), packed(cut.astype(layout.kind)), packed(left), packed(value), packed(gains))])])

    tasks = max(len(tops), math.ceil(n_rows * len(tops) / GROWN_ROWS))
    return blocks.mapInArrow(send, ROWS).repartition(tasks, "tree", "node").groupBy("tree", "node").applyInArrow(finish, TREE)


def fit_forest(train: DataFrame, dim: int, n_rows: int, classes: int, trees: int, depth: int, bins: int, seed: int,
               bagged: bool, wanted: int) -> ForestModel:
    """``trees`` trees over ``features`` and ``label``; ``classes`` 0 is a regression; ``wanted`` features are tried a node."""
    spark = train.sparkSession
    bounds = feature_bounds(train, dim, n_rows, bins, seed)
    layout, centre, unit = Layout(bounds), 0.0, 1.0
    if not classes:
        of = train.agg(F.avg("label").alias("m"), F.min("label").alias("a"), F.max("label").alias("b")).first()
        centre = float(of["m"])
        unit = whole_unit(max(of["b"] - centre, centre - of["a"]), 2 * n_rows)
    blocks = to_blocks(train, bounds, n_rows, centre, unit, 0)
    path, gains = scratch_path(spark, "forest"), np.zeros((trees, dim))
    step = max(1, BATCH_CELLS // n_rows)
    for first in range(0, trees, step):
        some = range(first, min(first + step, trees))
        tops, top_gains = _grow_tops(blocks, some, layout, classes, depth, seed, bagged, wanted, n_rows)
        gains[some.start : some.stop] += top_gains
        _shards(blocks, tops, layout, classes, depth, seed, bagged, wanted, n_rows).write.mode("append").parquet(f"{path}/trees")
        rows = [(t, -1, bytearray(packed(f)), bytearray(packed(c)), bytearray(packed(left)), bytearray(packed(np.array(tops[t].value))), bytearray()) for t in some for f, c, left in [tops[t].arrays()]]
        spark.createDataFrame(rows, TREE).write.mode("append").parquet(f"{path}/tops")
    blocks.unpersist()

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        return pd.DataFrame({"tree": group["tree"][:1], "gains": [sum(np.frombuffer(g) for g in group["gains"])]})

    grown = spark.read.schema(TREE).parquet(f"{path}/trees")
    for r in grown.select("tree", "node", "gains").groupBy("tree").applyInPandas(add, "tree int, gains array<double>").collect():
        gains[r["tree"]] += np.array(r["gains"])
    share = gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)
    weights = share.sum(axis=0) / max(share.sum(), 1e-300)
    model = ForestModel(classes=classes, numTrees=trees, centre=centre, sizes=[len(b) for b in bounds], bounds=[float(x) for b in bounds for x in b], importances=weights.tolist())
    return model.over(grown, spark.read.schema(TREE).parquet(f"{path}/tops"))


def whole_unit(largest: float, n_rows: int) -> float:
    """A power of two of which sums over all rows stay below 2^53, so that they are exact."""
    return 2.0 ** (math.ceil(math.log2(max(largest, 1e-300) * max(n_rows, 1))) - 52)


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.trees.write.parquet(f"{path}/trees")
        self.model.tops.write.parquet(f"{path}/tops")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        of, model = DefaultParamsReader.loadMetadata(path, self.sparkSession), ForestModel()
        model._resetUid(of["uid"])
        DefaultParamsReader.getAndSetParams(model, of)
        read = self.sparkSession.read.schema(TREE)
        return model.over(read.parquet(f"{path}/trees"), read.parquet(f"{path}/tops"))


class _Binned(Transformer, HasInputCol, HasOutputCol):
    sizes = Param(Params._dummy(), "sizes", "bounds a feature", TypeConverters.toListInt)
    bounds = Param(Params._dummy(), "bounds", "bounds of all features, one behind the other", TypeConverters.toListFloat)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for numbers", TypeConverters.toInt)
    centre = Param(Params._dummy(), "centre", "added to every number predicted", TypeConverters.toFloat)
    importances = Param(Params._dummy(), "importances", "importance of every feature", TypeConverters.toListFloat)

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.getOrDefault(self.importances))

    def all_bounds(self) -> list[np.ndarray]:
        ends = np.cumsum(self.getOrDefault(self.sizes))
        return np.split(np.array(self.getOrDefault(self.bounds)), ends[:-1])


class ForestModel(_Binned, MLReadable, MLWritable):
    """Trees whose shards are a table; a row's bins meet their shard of every tree by (tree, node)."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="prediction", classes=0, numTrees=1, centre=0.0, sizes=None, bounds=None, importances=None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="prediction", classes=0, numTrees=1, centre=0.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def over(self, trees: DataFrame, tops: DataFrame) -> ForestModel:
        self.trees, self.tops = trees, tops
        return self

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bounds, classes, centre = self.all_bounds(), self.getOrDefault(self.classes), self.getOrDefault(self.centre)
        layout, trees, width = Layout(bounds), self.getOrDefault(self.numTrees), max(classes, 1)
        tops = {}
        for r in self.tops.collect():
            feature, cut, left = (np.frombuffer(r[c], np.int64) for c in ("feature", "cut", "left"))
            tops[r["tree"]] = feature, cut, left, np.frombuffer(r["value"]).reshape(-1, width)
        most = max(256, (1 << 22) // (trees * width))
        routed = "tree int, node int, block long, at binary, codes binary"
        scored = "block long, tree int, at binary, votes binary"

        def votes(value: np.ndarray) -> np.ndarray:
            return value / value.sum(axis=1, keepdims=True) if classes else value

        @F.pandas_udf(T.BinaryType())
        def coded(xs: pd.Series) -> pd.Series:
            codes = to_codes(np.vstack(xs.to_numpy()), bounds) if len(xs) else np.zeros((0, layout.dim), layout.kind)
            return pd.Series([c.tobytes() for c in codes], dtype=object)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seq = 0
            for b in batches:
                raw = b.column(0).to_pylist()
                for a in range(0, len(raw), most):
                    codes = layout.codes(b"".join(raw[a : a + most]))
                    block = (TaskContext.get().partitionId() << 32) + seq
                    seq += 1
                    yield batch(routed, [(-1, seq, block, b"", packed(codes))])  # the bins themselves, kept for the sum
                    for t, (feature, cut, left, value) in tops.items():
                        at, out = descend(feature, cut, left, codes), []
                        for n in np.unique(at):
                            mine = np.flatnonzero(at == n).astype(np.int32)
                            if feature[n] == SHARD:
                                out.append((t, int(n), block, packed(mine), packed(codes[mine])))
                            else:  # a leaf above the shards: its value goes along
                                out.append((-2 - t, int(n), block, packed(mine), packed(np.repeat(votes(value[n : n + 1]), len(mine), axis=0))))
                        yield batch(routed, out)

        def meet(rows: pa.Table, shard: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.Table.from_batches([batch(scored, [])])
            t = rows["tree"][0].as_py()
            if t < 0:
                return pa.Table.from_batches([batch(scored, [(b.as_py(), t if t == -1 else -2 - t, at.as_py(), v.as_py()) for b, at, v in zip(rows["block"], rows["at"], rows["codes"])])])
            tree = shard.to_pylist()[0]
            feature, left = np.frombuffer(tree["feature"], np.int32), np.frombuffer(tree["left"], np.int32)
            cut, value = np.frombuffer(tree["cut"], layout.kind), votes(np.frombuffer(tree["value"]).reshape(-1, width))
            out = [(b.as_py(), t, at.as_py(), packed(value[descend(feature, cut, left, layout.codes(c.as_py()))])) for b, at, c in zip(rows["block"], rows["at"], rows["codes"])]
            return pa.Table.from_batches([batch(scored, out)])

        def total(table: pa.Table) -> pa.Table:
            table = table.sort_by("tree")
            kept = table["tree"].to_pylist().index(-1)
            codes = layout.codes(table["votes"][kept].as_py())
            sums = np.zeros((len(codes), width))
            for t, at, v in zip(table["tree"], table["at"], table["votes"]):
                if t.as_py() >= 0:
                    sums[np.frombuffer(at.as_py(), np.int32)] += np.frombuffer(v.as_py()).reshape(-1, width)
            result = np.argmax(sums, axis=1).astype(float) if classes else sums[:, 0] / trees + centre
            return pa.Table.from_batches([batch("codes binary, result double", [(c.tobytes(), float(x)) for c, x in zip(codes, result)])])

        data = dataset.withColumn("__codes", coded(vector_to_array(F.col(self.getInputCol()))))
        keys = data.select("__codes").distinct().sortWithinPartitions("__codes").mapInArrow(route, routed)
        met = keys.groupBy("tree", "node").cogroup(self.trees.groupBy("tree", "node")).applyInArrow(meet, scored)
        found = met.groupBy("block").applyInArrow(total, "codes binary, result double").select(F.col("codes").alias("__codes"), F.col("result").alias(self.getOutputCol()))
        return data.join(found, "__codes").drop("__codes")


# ------------------------------------------------------------------ boosting
def place(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of the leaf every row comes to, from bins by feature: few nodes, so all their tests are made for all rows, a bit a level."""
    if len(feature) > FEW_NODES:
        return value[settle(feature, cut, left, np.ascontiguousarray(columns.T))]

    def below(node: int) -> tuple[list[np.ndarray], list]:
        """Right or left at each further level, and the values by these bits, the first the highest."""
        if feature[node] < 0:
            return [], [value[node]]
        (low, lows), (high, highs) = below(int(left[node])), below(int(left[node]) + 1)
        right, deep = columns[feature[node]] > int(cut[node]), max(len(low), len(high))
        low, lows = low + [none] * (deep - len(low)), [v for v in lows for _ in range(1 << (deep - len(low)))]
        high, highs = high + [none] * (deep - len(high)), [v for v in highs for _ in range(1 << (deep - len(high)))]
        return [right, *(w ^ (right & (w ^ h)) for w, h in zip(low, high))], [*lows, *highs]

    none = np.zeros(columns.shape[1], bool)
    bits, values = below(0)
    at = none.view(np.uint8)
    for bit in bits:
        at = at + at
        at |= bit.view(np.uint8)
    return np.array(values).take(at)


def _margins(columns: np.ndarray, margin: np.ndarray, trees: list[tuple], rate: list[float]) -> np.ndarray:
    """Margins by class after some more trees; a tree is (feature, cut, left, value) for every class."""
    out = margin.copy()
    for by_class, r in zip(trees, rate):
        for k, tree in enumerate(by_class):
            out[k] += r * place(columns, *tree)
    return out


class Counter:
    """Histograms of a block by node: two-bin features by their rows in the upper bin alone, the lower bin is the rest."""

    def __init__(self, columns: np.ndarray, layout: Layout):
        self.start, self.bins = layout.start, layout.bins
        self.wide, self.two, self.one = np.flatnonzero(layout.bins > 2), np.flatnonzero(layout.bins == 2), np.flatnonzero(layout.bins == 1)
        self.codes, self.most = columns[self.wide].astype(np.int64), int(layout.bins.max(initial=1))
        self.of, self.rows = np.divmod(np.flatnonzero(columns[self.two]), max(columns.shape[1], 1))

    def add(self, into: tuple[np.ndarray, np.ndarray], at: np.ndarray, nodes: int, weight: np.ndarray) -> None:
        """Adds rows and weights to (node, bin); rows at node ``nodes`` are left out."""
        base = at * self.most
        for f, codes in zip(self.wide, self.codes):
            key, m, start = base + codes, self.bins[f], self.start[f]
            for to, w in zip(into, (None, weight)):
                to[:, start : start + m] += np.bincount(key, w, (nodes + 1) * self.most).reshape(-1, self.most)[:nodes, :m]
        m = len(self.two)
        key = at[self.rows] * m + self.of
        for to, w in zip(into, (None, weight)):
            total = np.bincount(at, w, nodes + 1)[:nodes, None]
            if m:
                upper = np.bincount(key, None if w is None else w[self.rows], (nodes + 1) * m).reshape(-1, m)[:nodes]
                to[:, self.start[self.two] + 1] += upper
                to[:, self.start[self.two]] += total - upper
            to[:, self.start[self.one]] += total


def _targets(y: np.ndarray, margin: np.ndarray, classes: int, first: bool, unit: float) -> np.ndarray:
    """What the next trees fit, by class: ±1 or the number itself, later the loss's negative gradients, in whole units."""
    if not classes:
        out = y[None, :] if first else 2.0 * (y[None, :] - margin)
    else:
        sign = np.where(y[None, :] == (np.arange(classes)[:, None] if classes > 2 else 1), 1.0, -1.0)
        if first:
            out = sign
        else:
            out = 2.0 * sign * margin
            np.clip(out, -500, 500, out=out)
            np.exp(out, out=out)
            out += 1.0
            out = 4.0 * sign / out
    return np.round(out / unit) * unit


def fit_boosted(train: DataFrame, dim: int, n_rows: int, classes: int, iters: int, depth: int, bins: int, seed: int, rate: float = 0.1) -> BoostedModel:
    """Gradient boosting: squared error for numbers, log loss for two classes, one against the rest for more."""
    bounds = feature_bounds(train, dim, n_rows, bins, seed)
    layout, centre, models = Layout(bounds), 0.0, classes if classes > 2 else 1
    unit = whole_unit(4.0, n_rows)
    if not classes:
        of = train.agg(F.avg("label").alias("m"), F.min("label").alias("a"), F.max("label").alias("b")).first()
        centre = float(of["m"])
        unit = whole_unit(4.0 * (of["b"] - of["a"]), n_rows)
    blocks = to_blocks(train, bounds, n_rows, centre, unit if not classes else 1.0, models)
    recent: list[tuple] = []
    every, gains = [], np.zeros((iters, models, dim))

    def level(trees: list[list], rates: list[float], first: bool, now: list, open_: list[list[int]]) -> list:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, sums = ([np.zeros((len(o), layout.total)) for o in open_] for _ in range(2))
            for b in batches:
                for r in b.to_pylist():
                    columns, y = np.ascontiguousarray(layout.codes(r["codes"]).T), np.frombuffer(r["label"])
                    margin = _margins(columns, np.frombuffer(r["margin"]).reshape(models, -1), trees, rates)
                    target, counter = _targets(y, margin, classes, first, unit), Counter(columns, layout)
                    for k, nodes in enumerate(open_):
                        if not nodes:
                            continue
                        where = np.full(len(now[k][0]), len(nodes))
                        where[nodes] = np.arange(len(nodes))
                        at = place(columns, *(np.array(x) for x in now[k][:3]), where)
                        counter.add((rows[k], sums[k]), at, len(nodes), target[k])
            for k in range(models):
                n, s = rows[k].ravel(), sums[k].ravel()
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), k, np.int32)), pa.array(has), pa.array(n[has]), pa.array(s[has])], names=["k", "at", "n", "s"])

        counted = blocks.mapInArrow(count, "k int, at long, n double, s double")
        if math.ceil(n_rows / TASK_ROWS) * sum(map(len, open_)) * layout.total > DIRECT_CELLS:  # else the tasks' sums go to the driver as they are
            counted = counted.groupBy("k", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        return counted.toArrow()

    for i in range(iters):
        now: list = [([LEAF], [0], [0], [0.0]) for _ in range(models)]
        open_ = [[0] for _ in range(models)]
        for _ in range(depth):
            if not any(open_):
                break
            found = level([t for t, _ in recent], [r for _, r in recent], i == 0, now, open_)
            ks, at, n, s = (found[c].to_numpy() for c in ("k", "at", "n", "s"))
            then: list[list[int]] = [[] for _ in range(models)]
            for k, nodes in enumerate(open_):
                mine, size = ks == k, len(nodes) * layout.total
                hist = np.column_stack([np.bincount(at[mine], x[mine], size) for x in (n, s)])
                feature, cut, left, value = now[k]
                for node, h in zip(nodes, hist.reshape(len(nodes), layout.total, 2)):
                    whole = h[: layout.bins[0]].sum(axis=0)
                    value[node] = whole[1] / max(whole[0], 1.0)
                    gain, f, c, first = best_of_histogram(h, layout, 0)
                    if f == LEAF or gain <= 1e-12 * score([whole[:1], whole[1:]], 0)[0]:
                        continue
                    feature[node], cut[node], left[node] = f, c, len(feature)
                    gains[i, k, f] += gain
                    for side in (first, whole - first):
                        then[k].append(len(feature))
                        feature.append(LEAF), cut.append(0), left.append(0), value.append(side[1] / side[0])
            open_ = then
        grown = tuple(tuple(map(np.array, tree)) for tree in now)
        recent.append((grown, 1.0 if i == 0 else rate))
        every.append(grown)
        if len(recent) == KEEP and i + 1 < iters:
            blocks, recent = _refreshed(blocks, layout, models, recent), []
    blocks.unpersist()
    by_model = gains.sum(axis=0)
    by_model /= np.maximum(by_model.sum(axis=1, keepdims=True), 1e-300)
    nodes = max(len(tree[0]) for it in every for tree in it)
    flat = [np.zeros((iters, models, nodes)) for _ in range(4)]
    for i, it in enumerate(every):
        for k, tree in enumerate(it):
            for to, of in zip(flat, tree):
                to[i, k, : len(of)] = of
    feature, cut, left, value = (x.ravel().tolist() for x in flat)
    return BoostedModel(classes=classes, centre=centre, rate=rate, sizes=[len(b) for b in bounds], bounds=[float(x) for b in bounds for x in b], importances=by_model.mean(axis=0).tolist(), nodes=nodes, feature=feature, cut=cut, left=left, value=value)


def _refreshed(blocks: DataFrame, layout: Layout, models: int, recent: list[tuple]) -> DataFrame:
    """The blocks with the margins after the recent trees; the old ones are let go."""
    trees, rates = [t for t, _ in recent], [r for _, r in recent]

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                margin = np.frombuffer(r["margin"]).reshape(models, -1)
                yield batch(BLOCK, [(r["part"], r["seq"], r["codes"], r["label"], packed(_margins(np.ascontiguousarray(layout.codes(r["codes"]).T), margin, trees, rates)))])

    fresh = materialise(blocks.mapInArrow(update, BLOCK), "tree_margins")
    blocks.unpersist()
    return fresh.persist(StorageLevel.MEMORY_AND_DISK)


class BoostedModel(_Binned, DefaultParamsReadable, DefaultParamsWritable):
    """Shallow trees of a boosting fit as flat lists (iterations × classes × nodes)."""

    rate = Param(Params._dummy(), "rate", "weight of every tree but the first", TypeConverters.toFloat)
    nodes = Param(Params._dummy(), "nodes", "places a tree", TypeConverters.toInt)
    feature = Param(Params._dummy(), "feature", "feature of every node, -1 for a leaf", TypeConverters.toListFloat)
    cut = Param(Params._dummy(), "cut", "last bin that goes left", TypeConverters.toListFloat)
    left = Param(Params._dummy(), "left", "left child", TypeConverters.toListFloat)
    value = Param(Params._dummy(), "value", "value of every node", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="prediction", classes=0, centre=0.0, rate=0.1, sizes=None, bounds=None, importances=None, nodes=1, feature=None, cut=None, left=None, value=None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="prediction", classes=0, centre=0.0, rate=0.1, nodes=1)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bounds, classes, centre, rate = self.all_bounds(), self.getOrDefault(self.classes), self.getOrDefault(self.centre), self.getOrDefault(self.rate)
        models, nodes = classes if classes > 2 else 1, self.getOrDefault(self.nodes)
        feature, cut, left = (np.array(self.getOrDefault(p)).astype(int).reshape(-1, models, nodes) for p in (self.feature, self.cut, self.left))
        value = np.array(self.getOrDefault(self.value)).reshape(-1, models, nodes)
        trees = [tuple((feature[i, k], cut[i, k], left[i, k], value[i, k]) for k in range(models)) for i in range(len(value))]
        rates = [1.0] + [rate] * (len(trees) - 1)

        @F.pandas_udf(T.DoubleType())
        def predict(xs: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=float)
            codes = to_codes(np.vstack(xs.to_numpy()), bounds)
            margin = _margins(np.ascontiguousarray(codes.T), np.zeros((models, len(codes))), trees, rates)
            if not classes:
                return pd.Series(margin[0] + centre)
            return pd.Series((margin[0] > 0).astype(float) if models == 1 else np.argmax(margin, axis=0).astype(float))

        return dataset.withColumn(self.getOutputCol(), predict(vector_to_array(F.col(self.getInputCol()))))
