"""ε-insensitive support vector regression on random Fourier features.

Minimises ½‖w‖² + C Σ max(0, |y − w·z − b| − ε) over all rows, z being the random
features of ``operators.kernels`` and b free of any penalty.  The corners of the loss are
rounded over a width μ, which shrinks until the duality gap is small; for each
μ Newton steps are taken.  A step is two passes: every task sums loss, gradient and
curvature of its rows in numpy (d² numbers, whatever the rows), the sums of many tasks meet in
a few groups, and the driver solves d equations; the second pass tells how much of the step to go.

The rounded loss gives a feasible dual point, so the gap between the two objectives
bounds the distance to the exact optimum without another solver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.kernels import rff_weights

#: Groups in which the tasks' sums meet; Newton steps for one width, and widths, at most; relative gap at which it is
#: done; relative gain of a step below which the width is done with; what a width is divided by; shares of a step tried at once.
GROUPS, STEPS, WIDTHS, GAP, CLOSE, NARROWER = 16, 12, 24, 1e-4, 1e-8, 8
SHARES = tuple(2.0**-i for i in range(14))


@dataclass
class SvrFit:
    weights: np.ndarray
    intercept: float
    objective: float
    gap: float
    passes: int


def random_features(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / w.shape[1]) * np.cos(x @ w + b)


def rounded(r: np.ndarray, mu: float, eps: float) -> np.ndarray:
    """The loss with both corners rounded over a width μ: softplus on either side."""
    return mu * (np.logaddexp(0, (r - eps) / mu) + np.logaddexp(0, (-r - eps) / mu))


def sums(z: np.ndarray, y: np.ndarray, theta: np.ndarray, mu: float, c: float, eps: float) -> np.ndarray:
    """Rounded loss, exact loss, Σα, Σ|α|, Σαy, Σα(z, 1) and the curvature of the rows, one behind the other."""
    z1 = np.column_stack([z, np.ones(len(z))])
    r = y - z1 @ theta
    up, down = (1 / (1 + np.exp(-np.clip((s * r - eps) / mu, -500, 500))) for s in (1, -1))
    alpha = c * (up - down)
    bent = z1 * np.sqrt(c / mu * (up * (1 - up) + down * (1 - down)))[:, None]
    return np.concatenate([[c * rounded(r, mu, eps).sum(), c * np.maximum(np.abs(r) - eps, 0).sum(), alpha.sum(), np.abs(alpha).sum(), alpha @ y], alpha @ z1, (bent.T @ bent).ravel()])


def losses(z: np.ndarray, y: np.ndarray, theta: np.ndarray, step: np.ndarray, mu: float, c: float, eps: float) -> np.ndarray:
    """Rounded loss after each share of the step."""
    z1 = np.column_stack([z, np.ones(len(z))])
    r, move = y - z1 @ theta, z1 @ step
    return np.array([c * rounded(r + t * move, mu, eps).sum() for t in SHARES])


def fit_svr(rows: DataFrame, features: str, label: str, dim: int, rff_dim: int, gamma: float, seed: int,
            c: float = 1.0, eps: float = 0.1) -> SvrFit:
    """The weights of the random features and the intercept; ``features`` is a vector column of ``dim`` numbers."""
    w, b = rff_weights(dim, rff_dim, gamma, seed)
    data = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    first = data.agg(F.expr("percentile_approx(y, 0.5)").alias("middle"), F.max(F.abs("y")).alias("most"), F.stddev_pop("y").alias("spread")).first()
    theta, size = np.zeros(rff_dim + 1), rff_dim + 1
    theta[-1] = first.middle or 0.0
    passes = 0

    def everywhere(of: Callable[..., np.ndarray], *args) -> np.ndarray:
        nonlocal passes
        passes += 1

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = 0.0
            for batch in batches:
                for start in range(0, len(batch), 4096):  # bounds the matrix of random features
                    part = batch.slice(start, 4096)
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                    total = total + of(random_features(x, w, b), part.column("y").to_numpy(zero_copy_only=False), *args, c, eps)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "s"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(s.as_py()) for s in table["s"])
            return pa.table({"s": pa.array([total.tobytes()], pa.binary())})

        partial = data.mapInArrow(own, "k int, s binary")
        if data.rdd.getNumPartitions() > 4 * GROUPS:  # else the tasks' sums go to the driver as they are
            partial = partial.groupBy("k").applyInArrow(add, "s binary")
        return sum(np.frombuffer(r.s) for r in partial.select("s").collect())

    fit = newton(everywhere, theta, max(float(first.spread or 0.0), eps, 1e-9), eps)
    return SvrFit(fit[0][:-1], float(fit[0][-1]), fit[1], fit[2], passes)


def newton(everywhere: Callable[..., np.ndarray], theta: np.ndarray, mu: float, eps: float) -> tuple[np.ndarray, float, float]:
    """The best weights (the intercept last), the exact objective and the duality gap; ``everywhere`` sums a function over all rows."""
    size = len(theta)

    def gap(s: np.ndarray, at: np.ndarray) -> tuple[float, float]:
        exact = 0.5 * at[:-1] @ at[:-1] + s[1]
        v = s[5 : 4 + size]
        return exact, exact - (s[4] - 0.5 * v @ v - eps * s[3]) + abs(at[-1] * s[2])  # Σα is 0 at the optimum

    for width in range(WIDTHS):
        for _ in range(STEPS):
            held = everywhere(sums, theta, mu)
            slope = np.append(theta[:-1], 0.0) - held[5 : 5 + size]
            curve = held[5 + size :].reshape(size, size) + np.diag(np.append(np.ones(size - 1), 1e-12))
            step = np.linalg.solve(curve, slope)
            value = 0.5 * theta[:-1] @ theta[:-1] + held[0]
            if slope @ step <= CLOSE * max(1.0, abs(value)):
                break
            along = everywhere(losses, theta, step, mu)
            tried = [0.5 * np.sum((theta - t * step)[:-1] ** 2) + a for t, a in zip(SHARES, along, strict=True)]
            if min(tried) >= value:
                break
            theta = theta - SHARES[int(np.argmin(tried))] * step
        exact, between = gap(held, theta)
        if between <= GAP * max(1.0, abs(exact)):
            break
        mu /= NARROWER
    held = everywhere(sums, theta, mu)
    exact, between = gap(held, theta)
    return theta, float(exact), float(between)
