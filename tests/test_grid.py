import math

import pytest
from pyspark.sql import functions as F

from quilt.functions.grid import Axis, Grid, ancestor, axis_split, bin_no, coordinate


def row_df(spark, values):
    cols = [f"f{i}" for i in range(len(values))]
    return spark.createDataFrame([tuple(float(v) for v in values)], ", ".join(f"{c} double" for c in cols))


def test_cell_number_92(spark):
    # axes 10 x 5 x 4 over columns 0, 1, 2 of (-1, 7, -8, 3, -9): 4*20 + 3*4 + 0
    df = row_df(spark, [-1, 7, -8, 3, -9])
    g = Grid.of(("f0", -50, 50, 10), ("f1", 0, 10, 5), ("f2", -10, 10, 4))
    assert g.multipliers == [20, 4, 1]
    assert df.select(bin_no(g).alias("b")).first().b == 92


def test_cell_number_92_added_one_by_one(spark):
    df = row_df(spark, [-1, 7, -8, 3, -9])
    g = Grid.of(("f0", -50, 50, 10)).add("f1", 0, 10, 5).add("f2", -10, 10, 4)
    assert df.select(bin_no(g).alias("b")).first().b == 92


def test_cell_number_92_axes_swapped(spark):
    df = row_df(spark, [7, -1, -8, 3, -9])
    g = Grid.of(("f1", -50, 50, 10), ("f0", 0, 10, 5), ("f2", -10, 10, 4))
    assert df.select(bin_no(g).alias("b")).first().b == 92


@pytest.mark.parametrize(
    "v,clamp,raw,null",
    [
        (0.0, 0, 0, 0),  # v = lo
        (10.0, 3, 4, None),  # v = hi: one past the end
        (-1.0, 0, 0, None),  # just below lo: truncation toward zero
        (-100.0, 0, -40, None),  # far below
        (1e6, 3, 400000, None),  # far above
        (float("nan"), 0, 0, None),
        (float("inf"), 3, 2**31 - 1, None),
        (float("-inf"), 0, -(2**31), None),
        (None, None, None, None),
    ],
)
def test_axis_split_policies(spark, v, clamp, raw, null):
    a = Axis("v", 0.0, 10.0, 4)
    df = spark.createDataFrame([(v,)], "v double")
    r = df.select(
        axis_split(F.col("v"), a, "clamp").alias("c"),
        axis_split(F.col("v"), a, "raw").alias("r"),
        axis_split(F.col("v"), a, "null").alias("n"),
    ).first()
    assert (r.c, r.r, r.n) == (clamp, raw, null)


def test_infinite_bounds_give_split_zero(spark):
    a = Axis("v", float("-inf"), float("inf"), 8)
    df = spark.createDataFrame([(3.0,), (-1e300,)], "v double")
    assert [r.s for r in df.select(axis_split(F.col("v"), a).alias("s")).collect()] == [0, 0]


@pytest.mark.parametrize(
    "axes",
    [
        [("a", 1, 1, 4)],  # hi = lo
        [("a", 2, 1, 4)],  # hi < lo
        [("a", 0, 1, 4), ("a", 0, 1, 2)],  # duplicate column
        [("a", 0, 1, 0)],  # no split
        [(f"a{i}", 0, 1, 2**16) for i in range(4)],  # 2^64 cells
    ],
)
def test_bad_grids_rejected(axes):
    with pytest.raises(ValueError):
        Grid.of(*axes)


def test_coordinates_and_ancestors(spark):
    g = Grid.of(("a", 0, 1, 10), ("b", 0, 1, 5), ("c", 0, 1, 4))
    df = spark.createDataFrame([(92,), (0,), (199,)], "bin_no bigint")
    rows = df.select(
        "bin_no",
        *[coordinate("bin_no", g, i).alias(f"c{i}") for i in range(3)],
        *[ancestor("bin_no", g, lv).alias(f"a{lv}") for lv in range(4)],
    ).collect()
    got = {r.bin_no: r for r in rows}
    assert (got[92].c0, got[92].c1, got[92].c2) == (4, 3, 0)
    assert (got[199].c0, got[199].c1, got[199].c2) == (9, 4, 3)
    assert (got[92].a0, got[92].a1, got[92].a2, got[92].a3) == (0, 80, 92, 92)
    for r in rows:
        assert r.c0 * 20 + r.c1 * 4 + r.c2 == r.bin_no


def test_grid_shape():
    g = Grid.of(("a", 0, 1, 10), ("b", 0, 1, 5), ("c", 0, 1, 4))
    assert g.dims == 3 and g.splits == [10, 5, 4] and g.cells == 200 and g.prefix_cells(1) == 50
    assert math.prod(g.splits) == g.cells
