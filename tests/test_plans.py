"""Plan checks: the points are only shuffled as partial aggregates, lookups
and models are broadcast, no Python runs inside any registered query, and
the parquet scan reads only the columns a query needs."""

import pytest

from conftest import SF001
from quilt.operators.train import gradient_sql

from quilt.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def queries():
    return catalog.SPARK


def test_no_python_in_any_registered_plan(spark, queries):
    for name, fn in queries.items():
        if name.startswith("train_") or name in ("strategy_report",):
            continue  # their models are fitted (driver loop) before the plan exists; checked below
        p = plan(fn(spark, SF001))
        for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
            assert bad not in p, (name, bad)


def test_routing_does_not_shuffle_points(spark, queries):
    p = plan(queries["assign_bin_group"](spark, SF001))
    assert p.count("LeftOuter, BuildRight") == 3  # one lookup per axis
    assert "SortMergeJoin" not in p
    # the only exchanges are broadcasts of the small level tables
    assert "hashpartitioning" not in p


def test_histogram_is_partial_then_final(spark):
    from quilt.operators.histogram import bin_histogram
    from quilt.plans.ensembles import Config
    from quilt.sources.points import points

    p = plan(bin_histogram(points(spark, SF001, "points_li"), Config().grid))
    assert "partial_count" in p and "Exchange hashpartitioning(bin_no" in p


def test_scan_prunes_columns(spark, queries):
    p = plan(queries["assign_bin_no"](spark, SF001))
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "l_comment" not in scan and "l_linestatus" not in scan
    assert "l_quantity" in scan


def test_gradient_step_plan(spark):
    df = spark.createDataFrame([(0, 1.0, 0.5), (1, 0.0, 1.5)], "model_id bigint, label double, x0 double")
    df.createOrReplaceTempView("__plan_train")
    p = plan(spark.sql(gradient_sql("__plan_train", 1, {0: [0.1], 1: [0.2]}, 2)))
    assert "Join" not in p and "partial_sum" in p
    assert "Python" not in p


def test_routed_scoring_broadcasts_models(spark, queries):
    p = plan(queries["predict_routed"](spark, SF001))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
