"""Scoring (G4, H1-H3): no shuffle of the points.

* global: the single model's weights are literals in the expression;
* routed: each row joins its piece's model from a model table (rows = number of
  models, known on the driver; broadcast when that is small);
* vote: every model scores every row. Few models of few features are one
  expression (a sum of per-model class indicators); many are a matrix product of
  a batch of rows with blocks of the weight matrix. The row is never replicated
  per model.

Features are columns, or one array column (``Models.array``): then a plan's size
does not depend on how many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilt.functions.logistic import dot, dot_array, sigmoid, threshold, usable, usable_array
from quilt.operators.train import Models
from quilt.session import broadcast_if_small, cut_lineage


def _null() -> Column:
    return F.lit(None).cast("double")


def _features(models: Models) -> list[Column]:
    return [F.col(c) for c in models.features]


def _usable(models: Models) -> Column:
    if models.array is not None:
        return usable_array(F.col(models.array), len(models.features))
    return usable(_features(models))


def predict_global(df: DataFrame, models: Models, t: float | None = 0.5, out: tuple[str, str] = ("probability", "prediction")) -> DataFrame:
    """H1: probability of the single model and, with a threshold, the class.
    Both are null for a row that is not usable, and where no model was fitted."""
    if not models.weights:
        margin = None
    elif models.array is not None:
        margin = dot_array(F.col(models.array), F.array(*[F.lit(float(w)) for w in models.weights[models.ids[0]]]))
    else:
        margin = dot(_features(models), models.weights[models.ids[0]])
    p = _null() if margin is None else F.when(_usable(models), sigmoid(margin))
    scored = df.withColumn(out[0], p)
    return scored.withColumn(out[1], threshold(F.col(out[0]), t)) if t is not None else scored


def predict_routed(
    df: DataFrame, models: Models, model_col: str, t: float | None = 0.5, out: tuple[str, str] = ("probability", "prediction")
) -> DataFrame:
    """H2: score each row with the model of its piece; rows that are not usable
    and rows whose piece has no model get a null probability and prediction. The
    weights of a model are one array, whatever its width."""
    k = len(models.features)
    mt = models.array_table(df.sparkSession, "__mid", "__w")
    joined = df.join(broadcast_if_small(mt, len(models.weights), k + 1), F.col(model_col) == F.col("__mid"), "left")
    if models.array is not None:
        margin = dot_array(F.col(models.array), F.col("__w"))
    else:
        margin = dot(_features(models), [F.get(F.col("__w"), j) for j in range(k)])
    p = F.when(_usable(models), sigmoid(margin))
    scored = joined.select(*[F.col(c) for c in df.columns if c != out[0]], p.alias(out[0]))
    return scored.withColumn(out[1], threshold(F.col(out[0]), t)) if t is not None else scored


# Terms of one compiled sum; longer votes are sums of such sums.
VOTE_CHUNK = 32
# Weights up to which a vote is an expression; more are a matrix product.
VOTE_EXPRESSION_WEIGHTS = 4096
# Bytes of weights in one block, and blocks that one pass over the rows holds.
VOTE_BLOCK_BYTES, VOTE_BLOCKS = 32 << 20, 2
# Cells (rows x models) of one product inside a task.
VOTE_CELLS = 4_000_000


def vote_count(models: Models, t: float) -> Column:
    """Number of models that vote 1: one 0/1 term per model, summed in an array
    of partial sums so that no generated method grows with the models."""
    xs = _features(models)
    votes = [F.when(sigmoid(dot(xs, models.weights[m])) > F.lit(float(t)), 1).otherwise(0) for m in models.ids]
    chunks = []
    for i in range(0, len(votes), VOTE_CHUNK):
        one = votes[i]
        for v in votes[i + 1 : i + VOTE_CHUNK]:
            one = one + v
        chunks.append(one)
    return F.aggregate(F.array(*chunks), F.lit(0), lambda acc, v: acc + v)


def _margin_above(t: float) -> float:
    """The least margin whose class is 1: ``1 / (1 + exp(-m)) > t`` as a bound on
    m, found by bisection over the doubles, so both ways give one answer."""
    if t < 0:
        return -np.inf
    lo, hi = -1000.0, 1000.0
    with np.errstate(over="ignore"):
        if not 1.0 / (1.0 + np.exp(-hi)) > t:
            return np.inf
        while True:
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                return hi
            if 1.0 / (1.0 + np.exp(-mid)) > t:
                hi = mid
            else:
                lo = mid


def _add_votes(df: DataFrame, x: str, ok: str, ones: str, blocks: list[np.ndarray], t: float) -> DataFrame:
    """``ones`` plus the votes of the models of ``blocks``, by a matrix product of
    the usable rows of a batch with each block (broadcast: its size is checked)."""
    held = [df.sparkSession.sparkContext.broadcast(b) for b in blocks]
    bar = _margin_above(t)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            good = batch.column(ok).to_numpy(zero_copy_only=False)
            total = batch.column(ones).to_numpy(zero_copy_only=False).copy()
            rows = batch.column(x).filter(pa.array(good))
            at = np.flatnonzero(good)
            width = held[0].value.shape[1]
            values = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(at), width)
            for b in held:
                step = max(1, VOTE_CELLS // max(1, len(b.value)))
                for i in range(0, len(at), step):
                    total[at[i : i + step]] += (values[i : i + step] @ b.value.T >= bar).sum(axis=1)
            columns = dict(zip(batch.schema.names, batch.columns))
            yield pa.RecordBatch.from_pydict(columns | {ones: pa.array(total, pa.int64())})

    return df.mapInArrow(run, df.schema)


def predict_vote(df: DataFrame, models: Models, t: float = 0.5, out: tuple[str, str] = ("ones", "prediction"), matrix: bool | None = None) -> DataFrame:
    """H3: ``ones``, the models that vote 1, and the majority of all present
    models; a tie gives 0. Both are null for a row that is not usable, and
    where no model was fitted. ``matrix`` forces how the votes are counted; with
    more than VOTE_BLOCKS blocks of weights the rows are written between passes,
    so that a task never holds more."""
    m, k = len(models.weights), len(models.features)
    if not m:
        return df.withColumn(out[0], F.lit(None).cast("int")).withColumn(out[1], _null())
    if matrix is None:
        matrix = models.array is not None or m * k > VOTE_EXPRESSION_WEIGHTS
    if matrix:
        x = F.col(models.array) if models.array is not None else F.array(*_features(models))
        scored = df.select("*", x.cast("array<double>").alias("__x"), _usable(models).alias("__ok"), F.lit(0).cast("bigint").alias("__ones"))
        weights = models.matrix()
        size = max(1, VOTE_BLOCK_BYTES // (8 * k))
        blocks = [weights[i : i + size] for i in range(0, m, size)]
        for i in range(0, len(blocks), VOTE_BLOCKS):
            scored = _add_votes(cut_lineage(scored) if i else scored, "__x", "__ok", "__ones", blocks[i : i + VOTE_BLOCKS], t)
        count = F.when(F.col("__ok"), F.col("__ones").cast("int"))
        scored = scored.select(*[F.col(c) for c in df.columns if c != out[0]], count.alias(out[0]))
    else:
        scored = df.withColumn(out[0], F.when(_usable(models), vote_count(models, t)))
    return scored.withColumn(
        out[1], F.when(F.col(out[0]).isNotNull(), F.when(F.col(out[0]) * 2 > F.lit(m), 1.0).otherwise(0.0))
    )
