import math
import random

import pytest
from pyspark.sql import functions as F

from dense_groups import box_of, dense_groups
from quilt.functions.grid import Grid
from quilt.operators.grouping import cut_axis, equi_depth_groups, group_members, route
from quilt.operators.histogram import dense_histogram, histogram_tree, tree_children
from quilt.operators.quality import group_adjacency, group_balance


def cut(spark, totals, q):
    return cut_axis(totals, q)


def test_axis_cut_is_linear_in_the_splits():
    import time

    def took(n):
        totals = [(i * 7919) % 13 for i in range(n)]
        t = time.perf_counter()
        for _ in range(5):
            cut_axis(totals, 20.0)
        return time.perf_counter() - t

    took(1000)
    assert took(160_000) < 8 * took(40_000)


def test_one_long_axis(spark):
    df = spark.createDataFrame([(i, 1 + i % 3) for i in range(16_000)], "bin_no bigint, n bigint")
    g = equi_depth_groups(df, Grid.of(("x0", 0.0, 1.0, 16_000)), 100)
    assert 90 <= g.n_groups <= 110 and g.groups.agg({"total": "sum"}).first()[0] == g.total


def test_route_with_the_users_own_column_names(spark):
    grid, _, g = grouped(spark, {k: 1 + k for k in range(12)}, [4, 3], 4)
    names = ["k0", "p0", "np0", "group_id", "path", "s", "__path"]
    df = spark.createDataFrame([(k, *["mine"] * len(names)) for k in range(12)], "bin_no bigint, " + ", ".join(f"{n} string" for n in names))
    got = {r.bin_no: r for r in route(df, g).collect()}
    plain = {r.bin_no: r.group_id for r in route(df.select("bin_no"), g).collect()}
    assert {k: r.group_id for k, r in got.items()} == plain
    assert all(r[n] == "mine" for r in got.values() for n in names if n != "group_id")


def test_axis_cut_empty_run_then_dropped_tail(spark):
    # empty run closed because the next coordinate holds more than 2q, then 9,
    # then a trailing run of total 0 that belongs to no group
    assert cut(spark, [0, 0, 9, 0], 2.0) == [(0, 1, 0), (2, 2, 9)]


def test_axis_cut_tie_rules(spark):
    # closing before the next coordinate when strictly nearer to the target
    assert cut(spark, [2, 0, 0, 2], 2.0) == [(0, 2, 2), (3, 3, 2)]
    assert cut(spark, [2, 1, 1, 0], 2.0) == [(0, 0, 2), (1, 3, 2)]
    # exact tie (q - t == t + x - q) keeps the run open
    assert cut(spark, [1, 2, 0, 1], 2.0) == [(0, 1, 3), (2, 3, 1)]
    for totals in ([0, 0, 9, 0], [2, 0, 0, 2], [2, 1, 1, 0], [1, 2, 0, 1]):
        runs = cut(spark, totals, 2.0)
        dense = dense_groups(dict(enumerate(totals)), [4], 4)  # 4 groups on 1 axis: q = total / 4
        q_total = sum(totals) / 4.0
        assert runs == cut(spark, totals, q_total) or q_total != 2.0
        assert [list(range(s, e + 1)) for s, e, _ in cut(spark, totals, q_total)] == list(dense.values())


def grouped(spark, cells, splits, n):
    grid = Grid.of(*[(f"a{i}", 0, 1, s) for i, s in enumerate(splits)])
    df = spark.createDataFrame([(k, v) for k, v in cells.items()] or [(0, 0)], "bin_no bigint, n bigint")
    return grid, df, equi_depth_groups(df, grid, n)


def as_dict(g):
    out = {}
    for r in group_members(g).collect():
        out.setdefault(r.group_id, []).append(r.bin_no)
    return {k: sorted(v) for k, v in out.items()}


def test_grouping_matches_dense_restatement(spark):
    rng = random.Random(11)
    for _ in range(6):
        d = rng.randint(1, 3)
        splits = [rng.randint(1, 5) for _ in range(d)]
        n = rng.randint(1, 9)
        cells = {}
        for _ in range(rng.randint(0, 40)):
            c = rng.randrange(math.prod(splits))
            cells[c] = cells.get(c, 0) + rng.randint(0, 3)
        grid, df, g = grouped(spark, cells, splits, n)
        expect = dense_groups(cells, splits, n)
        assert as_dict(g) == expect
        # every group is a box
        for gid, members in expect.items():
            box = box_of(members, splits)
            assert len(members) == math.prod(hi - lo + 1 for lo, hi in box)
        # routing of every cell agrees; unassigned cells are null (or 0)
        allc = spark.range(grid.cells).withColumnRenamed("id", "bin_no")
        inv = {c: k for k, v in expect.items() for c in v}
        got = {r.bin_no: r.group_id for r in route(allc, g, compatible=False).collect()}
        assert got == {c: inv.get(c) for c in range(grid.cells)}
        got0 = {r.bin_no: r.group_id for r in route(allc, g, compatible=True).collect()}
        assert got0 == {c: inv.get(c, 0) for c in range(grid.cells)}


@pytest.mark.parametrize(
    "cells,splits,n",
    [
        ({5: 3}, [4, 4], 4),  # one cell
        ({c: 1 for c in range(16)}, [4, 4], 4),  # all equal
        ({c: 0 for c in range(16)}, [4, 4], 4),  # all weights 0: no group
        ({c: 2 for c in range(16)}, [4, 4], 1),  # N = 1
        ({0: 1, 15: 1}, [4, 4], 50),  # N > rows
    ],
)
def test_grouping_edge_trees(spark, cells, splits, n):
    _, _, g = grouped(spark, cells, splits, n)
    assert as_dict(g) == dense_groups(cells, splits, n)


def weighted_512(seed):
    rng = random.Random(seed)
    bins = [0] * 512
    for _ in range(10000):
        bins[rng.randrange(512)] += rng.randint(0, 2)
    return {i: b for i, b in enumerate(bins)}


def test_groups_of_about_equal_size(spark):
    cells = weighted_512(2014)
    _, _, g = grouped(spark, cells, [8, 8, 8], 8)
    bal = group_balance(g.groups).collect()
    assert len(bal) == 8
    assert all(r.balanced for r in bal), [(r.total, r.lower, r.upper) for r in bal]
    assert sum(r.total for r in bal) == sum(cells.values())


def test_group_members_adjacent(spark):
    cells = weighted_512(7)
    grid, _, g = grouped(spark, cells, [8, 8, 8], 8)
    adj = group_adjacency(group_members(g), grid).collect()
    assert adj and all(r.adjacent for r in adj)


def test_single_cell_group_is_isolated(spark):
    grid, _, g = grouped(spark, {0: 10, 3: 10}, [4], 2)
    adj = {r.group_id: r for r in group_adjacency(group_members(g), grid).collect()}
    assert all(not r.adjacent for r in adj.values() if r.n_cells == 1)


def test_tree_invariants(spark):
    cells = weighted_512(3)
    grid = Grid.of(("a", 0, 1, 8), ("b", 0, 1, 8), ("c", 0, 1, 8))
    df = spark.createDataFrame(list(cells.items()), "bin_no bigint, n bigint")
    tree = histogram_tree(df, grid)
    root = tree.where("level = 0").first()
    assert root.subtotal == sum(cells.values()) and root.node_id == 0
    edges = tree_children(tree, grid)
    sums = edges.groupBy("level", "node_id").agg(F.sum("child_subtotal").alias("s"))
    bad = sums.join(tree, ["level", "node_id"]).where("s != subtotal").count()
    assert bad == 0
    dense = dense_histogram(spark, df.where("n > 0"), grid)
    assert dense.count() == 512 and dense.agg(F.sum("n")).first()[0] == sum(cells.values())


def test_rank_by_is_a_dense_order(spark):
    from quilt.operators.grouping import rank_by

    keys = random.Random(5).sample(range(10**9), 5000)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(13)
    got = {r.k: r.i for r in rank_by(df, "k", "i").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_invariants_on_lineitem(spark):
    from conftest import SF001
    from quilt.plans.ensembles import Config, Workbench

    wb = Workbench(spark, SF001, Config())
    g = wb.grouping()
    rows = wb.points().count()
    members = group_members(g, wb.counts())
    # each cell in at most one group; group totals add up to the row count
    assert members.count() == members.select("bin_no").distinct().count()
    assert g.groups.agg(F.sum("total")).first()[0] == rows
    assert members.agg(F.sum("n")).first()[0] == rows
    # the tree's root holds every row; every routed point has a group
    assert histogram_tree(wb.counts(), wb.cfg.grid).where("level = 0").first().subtotal == rows
    assert route(wb.binned(), g, compatible=False).where("group_id IS NULL").count() == 0


def test_unroutable_rows_stay_unrouted(spark):
    grid, _, g = grouped(spark, {c: 1 for c in range(16)}, [4, 4], 4)
    df = spark.createDataFrame([(5,), (None,)], "bin_no bigint")
    got = [r.group_id for r in route(df, g, compatible=True).orderBy(F.col("bin_no").asc_nulls_last()).collect()]
    assert got[0] is not None and got[1] is None
