"""The parallel cut of long axes against the walk."""

import random

import pytest

from quilt.operators.grouping import cut_axis
from quilt.operators.long_axis import long_axis_runs


def cut(spark, axes, q, splits, block):
    rows = [(p, c, w) for p, axis in axes.items() for c, w in enumerate(axis) if w or c % 3 == 0]
    per = spark.createDataFrame(rows, "path bigint, c0 bigint, w bigint").repartition(4)
    out = {p: [] for p in axes}
    for r in long_axis_runs(per, "c0", splits, q, block).collect():
        out[r["path"]].append((r["s"], r["e"], r["tot"]))
    return {p: sorted(v) for p, v in out.items()}


@pytest.mark.parametrize("block", [4, 37, 65_536])
@pytest.mark.parametrize("q", [0.0, 3.5, 10.0, 17.3, 1e9])
def test_equals_the_walk(spark, block, q):
    rng = random.Random(int(q * 10) + block)
    splits = 120
    axes = {
        0: [rng.randrange(0, 8) for _ in range(splits)],  # dense
        7: [rng.randrange(1, 40) if rng.random() < 0.15 else 0 for _ in range(splits)],  # sparse, with jumps
        20: [0] * 50 + [5] * 20 + [0] * 50,
        21: [0] * (splits - 1) + [9],
        33: [100] + [0] * (splits - 1),
        40: [1] * splits,
        50: [rng.choice([0, 0, 10, 20]) for _ in range(splits)],  # totals that meet the target
    }
    assert cut(spark, axes, q, splits, block) == {p: cut_axis(a, q) for p, a in axes.items()}


def test_no_weight_no_runs(spark):
    assert long_axis_runs(spark.createDataFrame([], "path bigint, c0 bigint, w bigint"), "c0", 10, 1.0).collect() == []
    assert cut(spark, {3: [0] * 12}, 1.0, 12, 4) == {3: []}


def test_many_runs_over_many_blocks(spark):
    rng = random.Random(9)
    axis = [rng.randrange(0, 5) for _ in range(20_000)]
    assert cut(spark, {1: axis}, 7.0, len(axis), 256) == {1: cut_axis(axis, 7.0)}


def test_grouping_takes_the_long_way(spark, monkeypatch):
    from quilt.functions.grid import Grid
    from quilt.operators import grouping

    rng = random.Random(2)
    grid = Grid.of(("x0", 0.0, 1.0, 40), ("x1", 0.0, 1.0, 12))
    cells = spark.createDataFrame([(i, rng.randrange(1, 30)) for i in rng.sample(range(grid.cells), 200)], "bin_no bigint, n bigint")
    want = sorted(map(tuple, grouping.equi_depth_groups(cells, grid, 9).groups.collect()))
    monkeypatch.setattr(grouping, "LONG_AXIS", 3)
    assert sorted(map(tuple, grouping.equi_depth_groups(cells, grid, 9).groups.collect())) == want
