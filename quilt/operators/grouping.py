"""Equi-depth grouping of grid cells.

Semantics (greedy cut, axis by axis): with ``f = N ** (1/D)`` the target on
axis l is ``q_l = total / f**(l+1)`` (the target is divided again at each
level, whatever the real subtotal of a run). Walking the coordinates of an
axis with running total ``t`` and next coordinate's total ``x``, the current
run is closed after coordinate i when ``t > q`` or when ``t <= q < t + x`` and
``q - t < t + x - q``. A leftover run at the end of the axis is kept only if
its total is > 0. Each run is cut again along the next axis, all of its cells
pooled; runs on the last axis are the groups, numbered depth first. Every
group is therefore a box: one coordinate interval per axis.

Plan: one level at a time on the sparse cell table.
  level l: cells (path, c_l, n) --sum--> per path an array of S_l totals
           --one linear walk per row--> runs (path, s, e, tot)
           --explode--> segment table (path, c) -> next path
  A path is the id of the box's lowest corner cell, so it is one bigint and
  its numeric order is the depth-first order of the runs.
Points and cells are routed by D equi-joins on (path, c_l) with the segment
tables, which are broadcast when their counted size allows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilt.functions.grid import Grid, coordinate
from quilt.operators.long_axis import long_axis_runs
from quilt.session import broadcast_if_small, cut_lineage

MEMBER_SPREAD = 100_000  # cells still to generate per row above which rows are reshuffled
# Beyond this many coordinate prefixes a level table is counted, not bounded.
STATIC_ROWS = 2_000_000
# Splits of an axis up to which one row may hold it.
LONG_AXIS = 100_000


def divide_factor(n_groups: int, dims: int) -> float:
    return float(n_groups) ** (1.0 / dims)


def level_targets(total: float, n_groups: int, dims: int) -> list[float]:
    """Target of each level by repeated division (same order as the oracle)."""
    f = divide_factor(n_groups, dims)
    out, q = [], float(total)
    for _ in range(dims):
        q = q / f
        out.append(q)
    return out


def level_target_cols(total: Column, n_groups: int, dims: int) -> list[Column]:
    f = divide_factor(n_groups, dims)
    out, q = [], total.cast("double")
    for _ in range(dims):
        q = q / F.lit(f)
        out.append(q)
    return out


def _bigint(v: int | Column) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("bigint")


def cut_axis(totals: list[int], q: float) -> list[tuple[int, int, int]]:
    """E5: runs (first, last, total) of one axis from its totals by coordinate.
    One walk, linear in the splits."""
    runs, t, s = [], 0, 0
    for i, a in enumerate(totals):
        t += a
        x = totals[i + 1] if i + 1 < len(totals) else 0
        if t > q or (q < t + x and q - t < t + x - q):
            runs.append((s, i, t))
            t, s = 0, i + 1
    if t > 0:
        runs.append((s, len(totals) - 1, t))
    return runs


def axis_runs(per: DataFrame, coord: str, splits: int, target: float) -> DataFrame:
    """Runs ``(path, s, e, tot)`` from the totals ``(path, coord, w)``. Up to
    LONG_AXIS splits a row holds the occupied coordinates of one box along one
    axis, and the greedy walk runs inside the row; a longer axis is cut in parallel
    (see ``long_axis``)."""
    if splits > LONG_AXIS:
        return long_axis_runs(per, coord, splits, target)
    boxes = per.groupBy("path").agg(F.collect_list(F.struct(F.col(coord).alias("c"), F.col("w").alias("w"))).alias("cells"))

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for path, cells in zip(batch.column("path").to_pylist(), batch.column("cells").to_pylist()):
                totals = [0] * splits
                for cell in cells:
                    totals[cell["c"]] = cell["w"]
                out += [(path, *run) for run in cut_axis(totals, target)]
            yield pa.RecordBatch.from_pydict(
                {name: pa.array([r[j] for r in out], pa.int64()) for j, name in enumerate(("path", "s", "e", "tot"))}
            )

    return boxes.mapInArrow(cut, "path bigint, s bigint, e bigint, tot bigint")


@dataclass
class Grouping:
    """Result of E6 plus the tables needed to route rows.

    ``levels[l]`` is the checkpointed table of level l with one row per
    (path, coordinate) that has a run: ``(path, k, s, e, tot)``."""

    grid: Grid
    n_wanted: int
    total: int
    targets: list[float]
    levels: list[DataFrame]
    level_rows: list[int]  # upper bounds of the level tables' row counts
    groups: DataFrame  # (group_id, group_key, lo0, hi0, ..., total)

    @property
    def n_groups(self) -> int:
        if not hasattr(self, "_n_groups"):
            self._n_groups = self.groups.count()
        return self._n_groups

    def runs(self, level: int) -> DataFrame:
        """Runs of one level: ``(path, s, e, tot)``."""
        return self.levels[level].where(F.col("k") == F.col("s")).select("path", "s", "e", "tot")

    def segment(self, level: int) -> DataFrame:
        """Routing table of a level: ``(__q_path, __q_k, __q_next)``, the last
        level ``(__q_path, __q_k, __q_group)``; names no input column has."""
        t = self.levels[level]
        if level < self.grid.dims - 1:
            return t.select(
                F.col("path").alias("__q_path"),
                F.col("k").alias("__q_k"),
                (F.col("path") + F.col("s") * F.lit(self.grid.multipliers[level])).alias("__q_next"),
            )
        key = F.col("path") + F.col("s") * F.lit(self.grid.multipliers[level])
        ids = self.groups.select(F.col("group_key").alias("__gk"), "group_id")
        return t.join(broadcast_if_small(ids, self.level_rows[level]), key == F.col("__gk")).select(
            F.col("path").alias("__q_path"), F.col("k").alias("__q_k"), F.col("group_id").alias("__q_group")
        )


ROWS_PER_PARTITION = 500_000


def _compact(df: DataFrame, bound: int) -> DataFrame:
    """A table with a proven row bound gets one partition per 500k bounded
    rows (no shuffle): its checkpoint is a few files, not one per shuffle
    partition of the cluster."""
    return df.coalesce(max(1, math.ceil(bound / ROWS_PER_PARTITION)))


def rank_by(df: DataFrame, key: str, out: str, bound: int | None = None) -> DataFrame:
    """0-based position of each row in ``key`` order (keys unique), computed
    without a window over the whole table: rows are range-partitioned on
    ``key``, numbered inside each partition, and shifted by the row counts of
    the partitions before (a table of one row per partition). The partition
    id is stored with the rows (checkpoint) before it is read twice, so both
    reads see the same partitioning whatever the runtime re-planning does."""
    ranged = df.repartitionByRange(max(1, math.ceil(bound / ROWS_PER_PARTITION)), key) if bound else df.repartitionByRange(key)
    parted = cut_lineage(ranged.withColumn("__pid", F.spark_partition_id()))
    local = parted.withColumn(
        "__local", F.row_number().over(Window.partitionBy("__pid").orderBy(key)) - 1
    )
    sizes = parted.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(
        "__pid",
        F.coalesce(
            F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
    )
    return local.join(F.broadcast(before), "__pid").select(
        *df.columns, (F.col("__off") + F.col("__local")).cast("bigint").alias(out)
    )


def _level_rows(grid: Grid, level: int, table: DataFrame) -> int:
    """A proven upper bound of a level table's rows: the number of coordinate
    prefixes (static); counted only when that bound is too large to trust."""
    bound = grid.prefix_cells(level)
    return bound if bound <= STATIC_ROWS else table.count()


def equi_depth_groups(cells: DataFrame, grid: Grid, n_groups: int, weight: str = "n") -> Grouping:
    """Merge adjacent cells of ``cells (bin_no, weight)`` into about
    ``n_groups`` boxes of about equal weight.

    Every intermediate table is small (at most one row per coordinate prefix)
    and is written to the checkpoint folder: later plans read it as a file
    instead of re-planning the whole chain of levels."""
    d = grid.dims
    mult = grid.multipliers
    cs = [f"c{i}" for i in range(d)]
    base = cut_lineage(
        _compact(
            cells.where(F.col("bin_no").isNotNull()).select(
                F.col(weight).cast("bigint").alias("w"), *[coordinate("bin_no", grid, i).alias(c) for i, c in enumerate(cs)]
            ),
            grid.cells,
        )
    )
    total = base.agg(F.sum("w")).first()[0] or 0
    targets = level_targets(total, n_groups, d)

    levels: list[DataFrame] = []
    rows: list[int] = []
    for lvl in range(d):
        # cells of this level: base routed through the earlier levels' tables
        cur = base.withColumn("path", _bigint(0))
        for j in range(lvl):
            seg = broadcast_if_small(
                levels[j].select(
                    F.col("path").alias("__p"), F.col("k").alias("__k"),
                    (F.col("path") + F.col("s") * F.lit(mult[j])).alias("__np"),
                ),
                rows[j],
            )
            cur = cur.join(seg, (F.col("path") == F.col("__p")) & (F.col(cs[j]) == F.col("__k"))).select(
                F.col("__np").alias("path"), "w", *cs
            )
        per = cur.groupBy("path", cs[lvl]).agg(F.sum("w").alias("w"))
        runs = axis_runs(per, cs[lvl], grid.splits[lvl], targets[lvl])
        table = cut_lineage(
            _compact(
                runs.select("path", F.explode(F.sequence("s", "e")).alias("k"), "s", "e", "tot"),
                grid.prefix_cells(lvl),
            )
        )
        levels.append(table)
        rows.append(_level_rows(grid, lvl, table))

    # boxes of the last-level runs: walk back through the levels by corner id
    box = levels[d - 1].where(F.col("k") == F.col("s")).select(
        F.col("path").alias("__parent"),
        (F.col("path") + F.col("s") * F.lit(mult[d - 1])).alias("group_key"),
        F.col("s").alias(f"lo{d - 1}"),
        F.col("e").alias(f"hi{d - 1}"),
        F.col("tot").alias("total"),
    )
    for lvl in range(d - 2, -1, -1):
        up = levels[lvl].where(F.col("k") == F.col("s")).select(
            (F.col("path") + F.col("s") * F.lit(mult[lvl])).alias("__child"),
            F.col("path").alias("__up"),
            F.col("s").alias(f"lo{lvl}"),
            F.col("e").alias(f"hi{lvl}"),
        )
        box = box.join(broadcast_if_small(up, rows[lvl]), F.col("__parent") == F.col("__child")).drop(
            "__parent", "__child"
        ).withColumnRenamed("__up", "__parent")
    bounds = [f for i in range(d) for f in (f"lo{i}", f"hi{i}")]
    # depth-first numbering = order of the corner ids; one row per group
    groups = cut_lineage(
        rank_by(box.select("group_key", *bounds, "total"), "group_key", "group_id", grid.prefix_cells(d - 1)).select(
            "group_id", "group_key", *bounds, "total"
        )
    )
    return Grouping(grid, n_groups, int(total), targets, levels, rows, groups)


def route(df: DataFrame, grouping: Grouping, bin_col: str = "bin_no", compatible: bool = True) -> DataFrame:
    """Add ``group_id`` to rows keyed by cell number. D left joins on
    (path, c_l); a cell in no group gets null, or 0 in ``compatible`` mode
    (the reference's default lookup value)."""
    grid = grouping.grid
    d = grid.dims
    cols = [c for c in df.columns if c != "group_id"]  # an older group is replaced
    out = df.select(*cols, _bigint(0).alias("__q_at"))
    for lvl in range(d):
        seg = broadcast_if_small(grouping.segment(lvl), grouping.level_rows[lvl])
        cond = (F.col("__q_at") == F.col("__q_path")) & (coordinate(bin_col, grid, lvl) == F.col("__q_k"))
        out = out.join(seg, cond, "left")
        if lvl < d - 1:
            out = out.select(*cols, F.col("__q_next").alias("__q_at"))
    gid = F.col("__q_group")
    if compatible:
        # cells outside every group read group 0, as the reference's lookup
        # array does; a row without a cell (null feature, or out of range
        # under the null policy) stays unrouted
        gid = F.when(F.col(bin_col).isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce(gid, _bigint(0)))
    return out.select(*cols, gid.alias("group_id"))


def group_members(grouping: Grouping, counts: DataFrame | None = None) -> DataFrame:
    """Every cell of every group (the box, empty cells included), as
    ``(group_id, bin_no[, n])``. Boxes are exploded axis by axis, so no row
    ever holds more than one axis' worth of coordinates."""
    grid = grouping.grid
    bounds = [f for i in range(grid.dims) for f in (f"lo{i}", f"hi{i}")]
    out = grouping.groups.select("group_id", _bigint(0).alias("bin_no"), *bounds)
    for i, m in enumerate(grid.multipliers):
        rest = bounds[2 * (i + 1):]
        out = out.select(
            "group_id", "bin_no", F.explode(F.sequence(f"lo{i}", f"hi{i}")).alias("__c"), *rest
        ).select("group_id", (F.col("bin_no") + F.col("__c") * F.lit(m)).alias("bin_no"), *rest)
        if m > MEMBER_SPREAD:
            # a big box would make all its cells in one task: deal the partly
            # expanded rows out before the next axes multiply them
            out = out.repartition("group_id", "bin_no")
    if counts is not None:
        out = out.join(counts.select("bin_no", "n"), "bin_no", "left").select(
            "group_id", "bin_no", F.coalesce(F.col("n"), _bigint(0)).alias("n")
        )
    return out
