"""Support vector classification of many classes on random Fourier features, one against the rest, for large tables.

For every class it minimises the mean of max(0, 1 − s(w·z/σ + b)) plus ‖w‖² / 2n over all n rows, s
being 1 for the class and −1 for the others, z the centred random features of ``operators.kernels`` and
σ their deviations: the objective, the steps (limited-memory quasi-Newton within orthants, a strong
Wolfe search, at most 100 steps) and the stopping rules of MLlib's ``LinearSVC``.  MLlib fits class
after class, a job for each trial of each step, and keeps the random features of all rows in memory
for every class.  Here the features are made anew in each pass and never kept, and one pass tells
loss and gradient at the next trials of all classes; a class that is done takes no part in further ones.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.kernels import rff_weights

#: Rows multiplied at once; tasks whose sums the driver adds itself (some 130 kB each at most), groups in which those of more tasks meet; classes
#: of a pass; trials of a class that are told ahead.
ROWS, DIRECT, GROUPS, CLASSES, AHEAD = 4096, 512, 16, 16, 4
#: MLlib's: steps at most, tolerance, steps that the curvature is taken from, values that convergence is told from, trials of a step.
ITERATIONS, TOLERANCE, MEMORY, VALUES, TRIALS = 100, 1e-6, 10, 20, 20


@dataclass
class SvcFit:
    weights: np.ndarray  # of the random features, by class
    intercepts: np.ndarray
    objectives: np.ndarray
    passes: int


def hinge_sums(z: np.ndarray, s: np.ndarray, thetas: np.ndarray) -> np.ndarray:
    """For every column of weights the loss and its gradient; ``s`` has the signs of the rows by column, ``z`` ends in ones."""
    r = 1.0 - s * (z @ thetas)
    return np.column_stack([np.maximum(r, 0).sum(0, dtype=np.float64), np.where(r > 0, -s, np.float32(0)).T @ z]).ravel()


def direction(g: np.ndarray, steps: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """Against the gradient, bent by the latest steps and changes of the gradient."""
    d, shares = -g, []
    for s, y in zip(reversed(steps), reversed(turns), strict=True):
        shares.append((s @ d) / (s @ y))
        d = d - shares[-1] * y
    if steps:
        d = d * (steps[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
    for s, y, share in zip(steps, turns, reversed(shares), strict=True):
        d = d + (share - (y @ d) / (s @ y)) * s
    return np.where(d * g < 0, d, 0.0)


def descent(size: int) -> Generator[list[np.ndarray], list[tuple[float, np.ndarray]], tuple[np.ndarray, float]]:
    """Asks for objective and gradient at some weights (the intercept last); ends with the best weights and their objective."""
    x, steps, turns, failed, done = np.zeros(size), [], [], False, 0
    ((f, g),) = yield [x]
    values = [f]
    while done < ITERATIONS:
        d = direction(g, steps, turns)
        falls, orthant = d @ g, np.where(x != 0, np.sign(x), -np.sign(g))
        share, less, known, found = (1.0, 0.5, {}, False) if done else (0.5 / max(np.sqrt(g @ g), 1e-300), 0.1, {}, False)
        for _ in range(TRIALS):
            if share not in known:
                ahead = [share]
                while len(ahead) < AHEAD:
                    ahead.append(ahead[-1] * less)
                points = [np.where(np.sign(x + a * d) == orthant, x + a * d, 0.0) for a in ahead]
                known |= dict(zip(ahead, zip(points, (yield points), strict=True), strict=True))
            point, (value, slope) = known[share]
            if value > f + 1e-4 * share * falls or (slope @ d >= 0.9 * falls and abs(slope @ d) > 0.9 * abs(falls)):
                share *= less
            elif slope @ d < 0.9 * falls:
                share *= 2.1
            else:
                found = True
                break
            if not 1e-10 < share < 1e10:
                break
        if not found:
            if failed or not steps:
                break
            failed, steps, turns = True, [], []
            continue
        if (point - x) @ (slope - g) > 0:
            steps, turns = [*steps, point - x][-MEMORY:], [*turns, slope - g][-MEMORY:]
        x, f, g, failed, done = point, value, slope, False, done + 1
        values = [*values, f][-VALUES:]
        if len(values) == VALUES and max(values) - f <= TOLERANCE * abs(f) or np.sqrt(g @ g) <= max(TOLERANCE * abs(f), 1e-8):
            break
    return x, f


def fit_svc(rows: DataFrame, features: str, label: str, classes: int, dim: int, rff_dim: int, gamma: float, seed: int) -> SvcFit:
    """Weights of the random features and intercepts for labels 0 … ``classes`` − 1; ``features`` is a vector column of ``dim`` numbers."""
    w, b = rff_weights(dim, rff_dim, gamma, seed)
    w32, b32, scale = w.astype(np.float32), b.astype(np.float32), np.float32(np.sqrt(2.0 / rff_dim))
    data = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"))
    tasks, size, passes = data.rdd.getNumPartitions(), rff_dim + 1, 0

    def everywhere(of) -> np.ndarray:
        """The sum of ``of(features and ones, labels)`` over all rows."""
        nonlocal passes
        passes += 1

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                for start in range(0, len(batch), ROWS):  # bounds the matrix of random features
                    part = batch.slice(start, ROWS)
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype(np.float32)
                    z = np.ones((len(part), size), np.float32)
                    np.cos(x @ w32 + b32, out=z[:, :-1])
                    z[:, :-1] *= scale
                    total = total + of(z, part.column("y").to_numpy(zero_copy_only=False))
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "s"])

        def add(table: pa.Table) -> pa.Table:
            return pa.table({"s": pa.array([sum(np.frombuffer(s.as_py()) for s in table["s"]).tobytes()], pa.binary())})

        partial = data.mapInArrow(own, "k int, s binary")
        if tasks > DIRECT:  # else the tasks' sums go to the driver as they are
            partial = partial.groupBy("k").applyInArrow(add, "s binary")
        return sum(np.frombuffer(r.s) for r in partial.select("s").collect())

    def moments(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = z[:, :-1].astype(np.float64)
        return np.concatenate([[len(z)], z.sum(0), (z**2).sum(0)])

    found = everywhere(moments)
    n, mean = found[0], found[1:size] / found[0]
    spread = np.sqrt(np.maximum(found[size : 2 * size - 1] - n * mean**2, 0) / max(n - 1, 1))
    turn = np.diag(np.append(np.where(spread > 1e-7, 1 / np.maximum(spread, 1e-300), 0.0), 1.0))  # constant features weigh nothing
    turn[-1, :-1] = -mean * np.diag(turn)[:-1]  # from weights of centred and scaled features, as MLlib takes them, to those of the features
    fits: list[tuple[np.ndarray, float]] = []
    for first in range(0, classes, CLASSES):
        solvers = {k: descent(size) for k in range(first, min(first + CLASSES, classes))}
        asked, ended = {k: next(s) for k, s in solvers.items()}, {}
        while asked:
            of = np.concatenate([np.full(len(points), k) for k, points in asked.items()])
            thetas = np.column_stack([turn @ p for points in asked.values() for p in points]).astype(np.float32)

            def all_sums(z: np.ndarray, y: np.ndarray) -> np.ndarray:
                return hinge_sums(z, np.where(y[:, None] == of, np.float32(1), np.float32(-1)), thetas)

            told = everywhere(all_sums).reshape(len(of), -1) / n
            for k, points in list(asked.items()):
                sums = [(t[0] + p[:-1] @ p[:-1] / (2 * n), t[1:] @ turn + np.append(p[:-1], 0.0) / n) for t, p in zip(told[of == k], points, strict=True)]
                try:
                    asked[k] = solvers[k].send(sums)
                except StopIteration as end:
                    ended[k] = end.value
                    del asked[k]
        fits += [ended[k] for k in solvers]
    weights = np.array([turn @ theta for theta, _ in fits])
    return SvcFit(weights[:, :-1], weights[:, -1], np.array([value for _, value in fits]), passes)
