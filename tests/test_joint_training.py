import random

import pytest

from quilt.operators.train import fit, fit_joint
from quilt.plans.ensembles import Config, Workbench

WAYS = {"by_a": ("a", 7), "by_b": ("b", 7), "one": (None, 3)}


def rows(spark, ids=(0, 1, 2, None)):
    rng = random.Random(6)
    made = []
    for i in range(400):
        x = [rng.random(), rng.random()]
        made.append((ids[i % len(ids)], rng.choice([0, 1, None]), float(x[0] > x[1]), x[0], None if i % 50 == 7 else x[1]))
    return spark.createDataFrame(made, "a bigint, b bigint, label double, x0 double, x1 double")


def test_joint_models_are_those_of_each_way(spark):
    df = rows(spark)
    joint = fit_joint(df, ["x0", "x1"], WAYS, partitions=2)
    for name, (of, n) in WAYS.items():
        own = fit(df, ["x0", "x1"], of, n)
        assert joint[name].counts == own.counts and len(joint[name].history) == n
        for m, w in own.weights.items():
            assert joint[name].weights[m] == pytest.approx(w, abs=1e-12)


def test_joint_leaves_what_it_cannot_hold(spark):
    assert fit_joint(rows(spark, (0, 10_000_000)), ["x0", "x1"], WAYS) is None
    empty = fit_joint(rows(spark).limit(0), ["x0", "x1"], WAYS)
    assert all(not m.weights for m in empty.values())
    with pytest.raises(ValueError):
        fit_joint(rows(spark).selectExpr("a", "b", "label + 1 AS label", "x0", "x1"), ["x0", "x1"], WAYS)


def test_rows_are_dealt_to_every_core(spark):
    cores = spark.sparkContext.defaultParallelism
    assert Workbench(spark, "", Config(partitions=1)).partitions == cores
    assert Workbench(spark, "", Config(partitions=cores + 3)).partitions == cores + 3
    assert Workbench(spark, "", Config(partitions=None)).partitions is None
