"""Converged, resumed and table-held training."""

import math

import numpy as np
import pytest

from quilt.operators.newton import fit_newton
from quilt.operators.train import fit
from quilt.operators.train_table import fit_table

NAN, INF = float("nan"), float("inf")


def points(spark, n=500, k=3, seed=2, groups=5, noise=0.8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    y = (x @ np.arange(1, k + 1) + rng.normal(scale=noise * k, size=n) > 0).astype(float)
    g = rng.integers(0, groups, size=n) * 10**6
    rows = [(str(i), float(y[i]), *map(float, x[i]), int(g[i])) for i in range(n)]
    cols = ", ".join(f"x{j} double" for j in range(k))
    return spark.createDataFrame(rows, f"key string, label double, {cols}, g bigint"), x, y, g


def numpy_gd(x, y, iters, step=1.0):
    w = np.zeros(x.shape[1])
    for t in range(1, iters + 1):
        w = w - (step / math.sqrt(t)) * ((1 / (1 + np.exp(-(x @ w))) - y) @ x / len(y))
    return w


def loss(w, x, y, l2):
    m = x @ w
    return (np.logaddexp(0, m) - y * m).mean() + l2 / 2 * w @ w


# ------------------------------------------------------------- converged


@pytest.mark.parametrize("l2", [0.0, 1e-3, 1.0])
def test_the_converged_model_is_the_minimum(spark, l2):
    df, x, y, _ = points(spark)
    got = fit_newton(df, ["x0", "x1", "x2"], l2)
    w = np.array(got.models.weights[0])
    gradient = (1 / (1 + np.exp(-(x @ w))) - y) @ x / len(y) + l2 * w
    assert got.done and np.abs(gradient).max() < 1e-12
    assert got.losses == sorted(got.losses, reverse=True)
    assert got.losses[-1] == pytest.approx(loss(w, x, y, l2), rel=1e-12)
    rng = np.random.default_rng(1)
    assert all(loss(w + rng.normal(size=3) * 0.01, x, y, l2) > got.losses[-1] for _ in range(20))


def test_loss_falls_on_separable_and_badly_scaled_rows(spark):
    """Full Newton steps overshoot here; halved ones do not."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [1.0, 1e3] + [0.0, 500.0]
    y = (x[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y)], "label double, x0 double, x1 double")
    got = fit_newton(df, ["x0", "x1"], 1e-4)
    assert got.losses == sorted(got.losses, reverse=True) and np.isfinite(got.models.weights[0]).all()
    assert ((x @ np.array(got.models.weights[0]) > 0) == (y > 0)).mean() > 0.98


def test_converged_edges(spark):
    schema = "label double, x0 double, x1 double"
    none = fit_newton(spark.createDataFrame([(1.0, NAN, 1.0), (0.0, None, 1.0), (1.0, INF, 0.0)], schema), ["x0", "x1"])
    assert none.models.weights == {}
    with pytest.raises(ValueError):
        fit_newton(spark.createDataFrame([(2.0, 1.0, 1.0)], schema), ["x0", "x1"])
    # a feature that is always zero: no curvature without a ridge
    zero = fit_newton(spark.createDataFrame([(1.0, 1.0, 0.0), (0.0, 1.0, 0.0), (1.0, 1.0, 0.0)], schema), ["x0", "x1"], 0.0)
    assert zero.models.weights[0][0] == pytest.approx(math.log(2)) and zero.models.weights[0][1] == 0
    df, x, y, _ = points(spark)
    from pyspark.sql import functions as F

    wide = fit_newton(df.select("label", F.array("x0", "x1", "x2").alias("x")), ["x0", "x1", "x2"], array="x")
    assert np.allclose(wide.models.weights[0], fit_newton(df, ["x0", "x1", "x2"]).models.weights[0], rtol=1e-10)


# --------------------------------------------------------------- resumed


def test_a_run_goes_on_from_its_last_written_step(spark, tmp_path):
    df, *_ = points(spark)
    names = ["x0", "x1", "x2"]
    whole = fit(df, names, "g", iterations=70)
    first = fit(df, names, "g", iterations=40, state=str(tmp_path), every=15)
    assert len(first.history) == 40
    again = fit(df, names, "g", iterations=70, state=str(tmp_path), every=15)
    assert len(again.history) == 30  # the other 40 steps are not run again
    assert again.weights == whole.weights and again.counts == whole.counts
    done = fit(df, names, "g", iterations=70, state=str(tmp_path))
    assert done.history == [] and done.weights == whole.weights
    # an earlier end finds the last step before it; another run has steps of its own
    early = fit(df, names, "g", iterations=35, state=str(tmp_path))
    assert len(early.history) == 5 and early.weights == fit(df, names, "g", iterations=35).weights
    other = fit(df, names[:2], "g", iterations=3, state=str(tmp_path))
    assert len(other.history) == 3


def test_a_step_that_was_not_finished_does_not_count(spark, tmp_path):
    df, *_ = points(spark)
    fit(df, ["x0"], None, iterations=10, state=str(tmp_path), every=5)
    (run,) = [p for p in tmp_path.iterdir()]
    broken = run / "step=20" / "_temporary" / "0"
    broken.mkdir(parents=True)
    (broken / "part-00000.parquet").write_bytes(b"PAR1")
    again = fit(df, ["x0"], None, iterations=12, state=str(tmp_path), every=5)
    assert len(again.history) == 2 and again.weights == fit(df, ["x0"], None, iterations=12).weights


def test_a_wide_run_is_resumed_too(spark, tmp_path):
    df, *_ = points(spark, n=100, k=20)
    names = [f"x{j}" for j in range(20)]
    fit(df, names, "g", iterations=3, state=str(tmp_path))
    assert fit(df, names, "g", iterations=6, state=str(tmp_path)).weights == fit(df, names, "g", iterations=6).weights


# ------------------------------------------------------------- as a table


@pytest.mark.parametrize("rows_per_cell,every", [(200_000, 5), (20, 1), (7, 4)])
def test_weights_as_a_table(spark, rows_per_cell, every):
    """With hot models dealt to several cells, and however often they are written."""
    df, x, y, g = points(spark, groups=6)
    df = df.union(spark.createDataFrame([("n", 1.0, None, 1.0, 1.0, 0), ("o", 1.0, NAN, 1.0, 1.0, 0), ("p", 1.0, 1.0, 1.0, 1.0, None)], df.schema))
    t = fit_table(df, ["x0", "x1", "x2"], "g", 9, rows_per_cell=rows_per_cell, every=every, partitions=5)
    got = {r["model_id"]: r for r in t.collect()}
    assert sorted(got) == sorted(set(g.tolist()))
    for m, r in got.items():
        assert r["n"] == (g == m).sum()
        assert np.allclose([r["w0"], r["w1"], r["w2"]], numpy_gd(x[g == m], y[g == m], 9), rtol=1e-11, atol=1e-14)


def test_a_step_moves_no_rows(spark):
    """The kept rows meet the weights where they are: what is shuffled is weights
    and sums, and the plan of a step refers to the weights before it once."""
    from pyspark.sql import functions as F

    df, *_ = points(spark)
    data = df.select(F.col("g").alias("model_id"), F.lit(0).alias("salt"), "x0").repartition(5, "model_id", "salt").persist()
    data.count()
    cells = spark.range(3).select((F.col("id") * 10**6).alias("model_id"), F.lit(0).alias("salt"), F.lit(0.5).alias("w0")).repartition(5, "model_id", "salt")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = data.join(cells, ["model_id", "salt"]).groupBy("model_id", "salt").agg(F.sum(F.col("x0") * F.col("w0")).alias("g0"))
        p = met._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert p.count("Exchange hashpartitioning") == 1  # of the weights
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        data.unpersist()


def test_table_edges(spark):
    df, *_ = points(spark)
    assert fit_table(df.where("false"), ["x0"], "g", 2).collect() == []
    with pytest.raises(ValueError):
        fit_table(spark.createDataFrame([(2.0, 1.0, 1)], "label double, x0 double, g bigint"), ["x0"], "g", 2)
