"""The converged single model (G1's alternative): Newton steps to the minimum of

    mean over rows of log(1 + exp(-s * w.x)), s = +-1 by label,  + l2 / 2 * |w|^2

Every iteration is one job: each task returns the partial sums of loss, gradient
and Hessian at the current weights, one row per position, and a grouped sum adds
them up; k * k + k + 2 numbers reach the driver, whatever the data size. A step
that does not lower the loss is halved, so the loss falls from step to step, and
the run ends when a step moves no weight by more than ``tol``. Rows that are not
usable take no part (see ``functions.logistic``).
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.functions.logistic import usable, usable_array
from quilt.operators.train import Models
from quilt.session import persist, spread

MAX_HALVINGS = 40


@dataclass
class Converged:
    models: Models
    losses: list[float] = field(default_factory=list)  # before the first step, and after each
    done: bool = False  # no step moved a weight by more than the tolerance


def sums_at(data: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Loss, gradient and Hessian sums and the number of rows over (label, x)."""
    k = len(w)

    def run(batches):
        total = np.zeros(k * k + k + 3)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            y = batch.column("label").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            m = x @ w
            with np.errstate(over="ignore"):
                p = 1.0 / (1.0 + np.exp(-m))
            total[0] += (np.logaddexp(0.0, m) - y * m).sum()
            total[1] += n
            total[2] += ((y != 0) & (y != 1)).sum()
            total[3 : 3 + k] += x.T @ (p - y)
            total[3 + k :] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total), dtype=np.int32)), "v": pa.array(total)})

    parts = data.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    total = np.zeros(k * k + k + 3)
    for at, v in parts.collect():
        total[at] = v
    if total[2]:
        raise ValueError("training labels must be 0 or 1 (binary logistic models)")
    return float(total[0]), total[3 : 3 + k], total[3 + k :].reshape(k, k), int(total[1])


def fit_newton(
    points: DataFrame, features: list[str], l2: float = 1e-3, iterations: int = 50, tol: float = 1e-10,
    partitions: int | None = None, array: str | None = None,
) -> Converged:
    """One model over all rows, to convergence. Without usable rows no model."""
    k = len(features)
    if array is not None:
        ok, x = usable_array(F.col(array), k), F.col(array).cast("array<double>")
    else:
        cols = [F.col(c).cast("double") for c in features]
        ok, x = usable(cols), F.array(*cols)
    rows = points.where(ok).select(F.col("label").cast("double").alias("label"), x.alias("x"))
    data = persist(spread(rows, partitions))
    history = []
    try:
        w = np.zeros(k)
        loss, g, h, n = sums_at(data, w)
        if not n:
            return Converged(Models(list(features), {}, {}, 0, array=array))

        def penalised(loss, w):
            return loss / n + l2 / 2 * float(w @ w)

        losses, done = [penalised(loss, w)], False
        while len(history) < iterations and not done:
            t0 = time.time()
            step = np.linalg.lstsq(h / n + l2 * np.eye(k), g / n + l2 * w, rcond=None)[0]
            for _ in range(MAX_HALVINGS):
                tried = w - step
                loss, g, h, _n = sums_at(data, tried)
                if penalised(loss, tried) <= losses[-1]:
                    break
                step = step / 2
            else:
                done = True  # no lower loss within rounding
                break
            w = tried
            losses.append(penalised(loss, w))
            done = bool(np.abs(step).max() <= tol)
            history.append(time.time() - t0)
    finally:
        data.unpersist()
    return Converged(Models(list(features), {0: w.tolist()}, {0: n}, len(history), 1.0, history, array), losses, done)
