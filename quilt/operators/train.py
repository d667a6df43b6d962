"""Logistic models fitted by full-batch gradient descent, all pieces at once.

The rule is the one of the classic SGD trainer with step 1, mini-batch
fraction 1, no intercept and no regularization, from zero weights:

    w <- w - (step / sqrt(t)) * (sum_rows((sigmoid(w.x) - y) * x) / n)

One Spark job per iteration serves every model: the training rows (persisted
once) meet the current weights and one grouped aggregate returns, per model,
the gradient sums. Only models x features numbers come back to the driver,
whatever the data size; the aggregate is partial per task, so a model holding a
third of all rows costs no more than any other. Pieces with no rows get no
model, and rows that are not usable (see ``functions.logistic``) take no part.

Narrow rows (up to 16 features, model ids dense) stay in generated code: the
weights are literal arrays indexed by the model id. Otherwise a step is one
vectorized pass: the features are one array column, and each task multiplies
its batches by the weight matrix and returns a partial sum per model. In both
the weights live on the driver between steps, 8 bytes each.
"""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.functions.logistic import usable, usable_array
from quilt.session import persist, spread


@dataclass
class Models:
    features: list[str]
    weights: dict[int, list[float]]
    counts: dict[int, int]
    iterations: int
    step: float = 1.0
    history: list[float] = field(default_factory=list)  # seconds per iteration
    array: str | None = None  # the column that holds the features, if they are one array

    @property
    def ids(self) -> list[int]:
        return sorted(self.weights)

    def rows(self) -> list[tuple]:
        return [(m, self.counts[m], *self.weights[m]) for m in self.ids]

    def schema(self, prefix: str = "w") -> str:
        return "model_id bigint, n bigint, " + ", ".join(f"{prefix}{j} double" for j in range(len(self.features)))

    def table(self, spark: SparkSession, prefix: str = "w") -> DataFrame:
        """``(model_id, n, w0..wk)``: one row per fitted model."""
        return spark.createDataFrame(self.rows(), self.schema(prefix))

    def array_table(self, spark: SparkSession, id_name: str, name: str) -> DataFrame:
        """One row per fitted model: its id and its weights as one array."""
        return spark.createDataFrame([(m, self.weights[m]) for m in self.ids], f"{id_name} bigint, {name} array<double>")

    def matrix(self) -> np.ndarray:
        return np.array([self.weights[m] for m in self.ids], float).reshape(len(self.ids), len(self.features))


def spark_double(v: float) -> str:
    """A Spark SQL double literal that parses back to exactly ``v``."""
    if math.isfinite(v):
        return f"{v!r}D"
    return f"CAST('{'NaN' if math.isnan(v) else ('Infinity' if v > 0 else '-Infinity')}' AS DOUBLE)"


# Literal weight arrays: most weights, and most features per row.
ARRAY_MAX_WEIGHTS = 100_000
ARRAY_MAX_FEATURES = 16


def gradient_sql(view: str, k: int, weights: dict[int, list[float]] | None, size: int = 0) -> str:
    """One step for every model: rows and ``sum((sigmoid(w.x) - y) * x_j)``, the
    residual computed once per row. Weight j of model i is element i of a
    literal array of ``size`` (a constant held once per task: the generated code
    is the same from step to step). ``None`` is the first step, from zero
    weights, which also counts the labels that are not 0 or 1."""
    xs = ", ".join(f"t.x{j}" for j in range(k))
    if weights is None:
        margin = "0.0D"
    else:
        cols = [[0.0] * size for _ in range(k)]
        for m, w in weights.items():
            for j in range(k):
                cols[j][m] = w[j]
        margin = " + ".join(
            f"t.x{j} * element_at(array({', '.join(spark_double(v) for v in cols[j])}), CAST(t.model_id + 1 AS INT))"
            for j in range(k)
        )
    rows = f"SELECT t.model_id, {xs}, t.label, (1.0D / (1.0D + exp(-({margin}))) - t.label) AS r FROM {view} t"
    sums = ", ".join(f"sum(r * x{j}) AS g{j}" for j in range(k))
    bad = ", sum(CASE WHEN label = 0.0D OR label = 1.0D THEN 0 ELSE 1 END) AS bad" if weights is None else ""
    return f"SELECT model_id, count(1) AS n, {sums}{bad} FROM ({rows}) GROUP BY model_id"


def gradient_vectorized(data: DataFrame, k: int, weights: dict[int, list[float]] | None) -> DataFrame:
    """The same step over ``(model_id, label, x array)``: a row per model and
    position, ``(model_id, pos, g, n, bad)``. A task holds one matrix of the
    models it meets."""
    known = np.array(sorted(weights or {}), np.int64)
    table = np.array([weights[m] for m in known.tolist()]) if weights else np.zeros((0, k))

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("model_id").to_numpy(zero_copy_only=False)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), k)
            margin = np.einsum("ij,ij->i", x, table[np.searchsorted(known, ids)]) if weights else np.zeros(len(ids))
            with np.errstate(over="ignore"):
                r = 1.0 / (1.0 + np.exp(-margin)) - y
            order = np.argsort(ids, kind="stable")
            found, first = np.unique(ids[order], return_index=True)
            bad = ((y != 0) & (y != 1)).astype(float)
            part = np.add.reduceat(np.column_stack((r[:, None] * x, np.ones(len(ids)), bad))[order], first, axis=0)
            for m, g in zip(found.tolist(), part, strict=True):
                sums[m] = sums[m] + g if m in sums else g
        for m, g in sums.items():
            yield pa.RecordBatch.from_pydict({
                "model_id": pa.array(np.full(k, m)), "pos": pa.array(np.arange(k, dtype=np.int32)), "g": pa.array(g[:k]),
                "n": pa.array(np.full(k, int(g[k]))), "bad": pa.array(np.full(k, int(g[k + 1]))),
            })

    parts = data.mapInArrow(run, "model_id bigint, pos int, g double, n bigint, bad bigint")
    return parts.groupBy("model_id", "pos").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def fit(
    points: DataFrame,
    features: list[str],
    model_col: str | None = None,
    iterations: int = 100,
    step: float = 1.0,
    partitions: int | None = None,
    vectorized: bool | None = None,
    array: str | None = None,
    state: str | None = None,
    every: int = 10,
) -> Models:
    """One model per distinct ``model_col`` value (one model overall
    when ``model_col`` is None). Rows with a null model id, and rows that are
    not usable, are not used. ``partitions`` deals the training rows to so many
    partitions once, for inputs with fewer splits than cores; by default the
    splits of the input stay as they are (they bound the bytes of a cached
    block). ``vectorized`` forces how a step is computed. ``array`` names a
    column that holds all ``features`` as one array. ``state`` names a folder on
    shared storage that belongs to these rows: every ``every`` steps the weights
    are written there, and a run that finds steps of its own (same features,
    pieces and step size) goes on from the last, with the same weights as a run
    that was never interrupted."""
    spark = points.sparkSession
    k = len(features)
    mid = (F.col(model_col) if model_col else F.lit(0)).cast("bigint")
    wide = array is not None or (k > ARRAY_MAX_FEATURES if vectorized is None else vectorized)
    if array is not None:
        ok, xs = usable_array(F.col(array), k), [F.col(array).cast("array<double>").alias("x")]
    else:
        cols = [F.col(c).cast("double") for c in features]
        ok, xs = usable(cols), [F.array(*cols).alias("x")] if wide else [c.alias(f"x{j}") for j, c in enumerate(cols)]
    rows = points.where(mid.isNotNull() & ok)
    # The training rows are kept in executor memory (spilling to disk) for all
    # steps. Their lineage is narrow: a file scan plus broadcast lookups into
    # small checkpointed tables, so a lost block is recomputed from its own
    # input split only; no copy of the whole training table is written.
    data = persist(spread(rows.select(mid.alias("model_id"), F.col("label").cast("double").alias("label"), *xs), partitions))
    view = f"__quilt_train_{uuid.uuid4().hex}"
    data.createOrReplaceTempView(view)
    weights: dict[int, list[float]] = {}
    counts: dict[int, int] = {}
    history = []
    done = 0
    if state is not None:
        state = f"{state.rstrip('/')}/{_run_name(features, model_col, step, array)}"
        done, weights, counts = load_state(spark, state, iterations)
    try:
        for t in range(done + 1, iterations + 1):
            t0 = time.time()
            current = weights if t > 1 else None
            if current and not wide and not _dense(weights, k):
                # ids with wide gaps: from here on as one array per row
                wide = True
                xs = F.array(*[F.col(f"x{j}") for j in range(k)]).alias("x")
            grads: dict[int, list[float]] = {}
            bad = 0
            if wide:
                table = data if "x" in data.columns else data.select("model_id", "label", xs)
                for r in gradient_vectorized(table, k, current).collect():
                    grads.setdefault(r["model_id"], [0.0] * k)[r["pos"]] = r["g"]
                    counts[r["model_id"]] = r["n"]
                    bad += r["bad"]
            else:
                size = max(weights) + 1 if weights else 0
                for r in spark.sql(gradient_sql(view, k, current, size)).collect():
                    grads[r["model_id"]] = [r[f"g{j}"] for j in range(k)]
                    counts[r["model_id"]] = r["n"]
                    bad += r["bad"] if t == 1 else 0
            if bad:
                raise ValueError("training labels must be 0 or 1 (binary logistic models)")
            if not grads:
                break  # no rows: no piece has a model
            rate = step / math.sqrt(t)
            for m, g in grads.items():
                w = weights.get(m, [0.0] * k)
                weights[m] = [w[j] - rate * (g[j] / counts[m]) for j in range(k)]
            history.append(time.time() - t0)
            if state is not None and (t % every == 0 or t == iterations):
                save_state(spark, state, t, weights, counts)
    finally:
        spark.catalog.dropTempView(view)
        data.unpersist()
    return Models(list(features), weights, counts, iterations, step, history, array)


def joint_gradient_sql(view: str, k: int, weights: dict[str, dict[int, list[float]]]) -> str:
    """One step for several ways to cut the same rows, in one pass: rows and
    ``sum((sigmoid(w.x) - y) * x_j)`` of each way, by the ids of all ways. ``m_i`` is
    the column of the i-th; no weights are the first step's zero weights."""
    xs = ", ".join(f"t.x{j}" for j in range(k))
    names = list(weights)
    margins = {}
    for name, of in weights.items():
        size = max(of) + 1 if of else 0
        cols = [[of[m][j] if m in of else 0.0 for m in range(size)] for j in range(k)]
        margins[name] = " + ".join(
            f"t.x{j} * element_at(array({', '.join(spark_double(v) for v in cols[j])}), CAST(t.{name} + 1 AS INT))"
            for j in range(k)
        ) if of else "0.0D"
    residuals = ", ".join(f"(1.0D / (1.0D + exp(-({margins[n]}))) - t.label) AS r_{n}" for n in names)
    ids = ", ".join(names)
    rows = f"SELECT {', '.join(f't.{n}' for n in names)}, {xs}, t.label, {residuals} FROM {view} t"
    sums = ", ".join(f"sum(r_{n} * x{j}) AS g_{n}_{j}" for n in names for j in range(k))
    bad = "sum(CASE WHEN label = 0.0D OR label = 1.0D THEN 0 ELSE 1 END) AS bad"
    return f"SELECT {ids}, count(1) AS n, {sums}, {bad} FROM ({rows}) GROUP BY {ids}"


# Combinations of ids that one pass may bring back to the driver in a step.
JOINT_MAX_GROUPS = 10_000


def fit_joint(
    points: DataFrame, features: list[str], ways: dict[str, tuple[str | None, int]], step: float = 1.0,
    partitions: int | None = None,
) -> dict[str, Models] | None:
    """The models that ``fit`` gives for each of ``ways`` (name -> model column or
    None for one model, iterations), from one kept copy of narrow rows and one
    pass a step for all of them: a step reads the rows once and looks each row up
    once. A row takes part in the ways in which it has an id. None where the ids of
    a way have wide gaps, or too many occur together: fit the ways one by one."""
    spark, k = points.sparkSession, len(features)
    cols = [F.col(c).cast("double") for c in features]
    names = {name: f"m_{i}" for i, name in enumerate(ways)}
    ids = [(F.col(of) if of else F.lit(0)).cast("bigint").alias(names[name]) for name, (of, _) in ways.items()]
    rows = points.where(usable(cols)).select(*ids, F.col("label").cast("double").alias("label"), *[c.alias(f"x{j}") for j, c in enumerate(cols)])
    data = persist(spread(rows.where(F.coalesce(*names.values()).isNotNull()), partitions))
    view = f"__quilt_train_{uuid.uuid4().hex}"
    data.createOrReplaceTempView(view)
    out = {name: Models(list(features), {}, {}, n, step) for name, (_, n) in ways.items()}
    try:
        for t in range(1, max(n for _, n in ways.values()) + 1):
            t0 = time.time()
            live = [name for name, (_, n) in ways.items() if t <= n]
            weights = {names[name]: out[name].weights for name in live}
            sums: dict[str, dict[int, list]] = {name: {} for name in live}
            found = spark.sql(joint_gradient_sql(view, k, weights)).collect()  # a row per combination of ids
            if any(r["bad"] for r in found):
                raise ValueError("training labels must be 0 or 1 (binary logistic models)")
            for r in found:
                for name in live:
                    if (m := r[names[name]]) is not None:
                        sums[name].setdefault(m, []).append((r["n"], [r[f"g_{names[name]}_{j}"] for j in range(k)]))
            if t == 1 and (len(found) > JOINT_MAX_GROUPS or not all(not of or _dense(of, k) for of in sums.values())):
                return None
            rate = step / math.sqrt(t)
            for name in live:
                models = out[name]
                for m, parts in sums[name].items():
                    models.counts[m] = n = sum(p[0] for p in parts)
                    w = models.weights.get(m, [0.0] * k)
                    models.weights[m] = [w[j] - rate * (math.fsum(p[1][j] for p in parts) / n) for j in range(k)]
                models.history.append(time.time() - t0)
    finally:
        spark.catalog.dropTempView(view)
        data.unpersist()
    return out


def _dense(weights: dict[int, list[float]], k: int) -> bool:
    """Ids 0..max with few gaps, and few enough weights for literal arrays."""
    lo, hi = min(weights), max(weights)
    return lo >= 0 and hi + 1 <= 4 * len(weights) and (hi + 1) * k <= ARRAY_MAX_WEIGHTS


def _run_name(features: list[str], model_col: str | None, step: float, array: str | None) -> str:
    import hashlib

    return "run-" + hashlib.sha256(repr((features, model_col, step, array)).encode()).hexdigest()[:16]


def save_state(spark: SparkSession, path: str, t: int, weights: dict[int, list[float]], counts: dict[int, int]) -> None:
    """The weights after step ``t``: one file, which appears as a whole."""
    rows = [(m, counts[m], weights[m]) for m in sorted(weights)]
    table = spark.createDataFrame(rows, "model_id bigint, n bigint, w array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/step={t}")


def load_state(spark: SparkSession, path: str, most: int) -> tuple[int, dict[int, list[float]], dict[int, int]]:
    """The last step written that is at most ``most``, or 0 and nothing."""
    from pyspark.errors import AnalysisException

    try:
        steps = spark.read.parquet(path).where(F.col("step") <= most)
        last = steps.agg(F.max("step")).first()[0]
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        last = None
    if last is None:
        return 0, {}, {}
    rows = steps.where(F.col("step") == last).collect()  # one row per model
    return int(last), {r["model_id"]: list(r["w"]) for r in rows}, {r["model_id"]: r["n"] for r in rows}
