"""Cell counts over a grid and their roll-up.

Points are reduced to sparse cell counts first (one partial + final hash
aggregate on a single bigint key); everything after that works on the cell
table, whose size is bounded by min(rows, cells), never on the points again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.functions.grid import Grid, ancestor, bin_no, coordinate


def with_bin_no(points: DataFrame, grid: Grid, policy: str = "clamp", out: str = "bin_no") -> DataFrame:
    """Key each point by its cell number."""
    return points.withColumn(out, bin_no(grid, policy))


def bin_histogram(points: DataFrame, grid: Grid, policy: str = "clamp") -> DataFrame:
    """Rows per non-empty cell, ``(bin_no, n)``. Rows whose cell is null
    (null feature, or out of range under the ``null`` policy) are not counted.
    Under ``clamp``/``raw`` a cell is null exactly when a grid feature is, so
    the test is on the features (pushed to the scan) rather than on the cell
    expression (which the optimizer would otherwise evaluate twice per row)."""
    if policy in ("clamp", "raw"):
        present = F.lit(True)
        for a in grid.axes:
            present = present & F.col(a.column).isNotNull()
        rows = points.where(present).select(bin_no(grid, policy).alias("bin_no"))
    else:
        rows = points.select(bin_no(grid, policy).alias("bin_no")).where(F.col("bin_no").isNotNull())
    return rows.groupBy("bin_no").agg(F.count(F.lit(1)).alias("n"))


def dense_histogram(spark: SparkSession, counts: DataFrame, grid: Grid) -> DataFrame:
    """Every cell 0..cells-1 with its count, 0 when empty."""
    cells = spark.range(grid.cells).withColumnRenamed("id", "bin_no")
    return cells.join(counts, "bin_no", "left").select(
        "bin_no", F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias("n")
    )


def with_cell_coordinates(counts: DataFrame, grid: Grid, bin_col: str = "bin_no") -> DataFrame:
    """D5 on a cell table: ``c0..c{D-1}`` from the cell number."""
    return counts.select("*", *[coordinate(bin_col, grid, i).alias(f"c{i}") for i in range(grid.dims)])


def histogram_tree(counts: DataFrame, grid: Grid, weight: str = "n") -> DataFrame:
    """Subtotal of every tree node that holds weight, as
    ``(level, node_id, subtotal)``. Level 0 is the root; a level-l node is a
    coordinate prefix of length l, its id the cell id with the rest set to 0."""
    d = grid.dims
    cs = [f"c{i}" for i in range(d)]
    rolled = (
        with_cell_coordinates(counts, grid)
        .rollup(*cs)
        .agg(F.sum(weight).cast("bigint").alias("subtotal"), F.grouping_id().alias("gid"))
    )
    level = F.lit(d) - F.bit_count(F.col("gid"))
    node = F.lit(0).cast("bigint")
    for c, m in zip(cs, grid.multipliers):
        node = node + F.coalesce(F.col(c), F.lit(0).cast("bigint")) * F.lit(m)
    return rolled.select(level.cast("bigint").alias("level"), node.alias("node_id"), "subtotal")


def tree_children(tree: DataFrame, grid: Grid) -> DataFrame:
    """parent/child edges of the tree in one pass, ``(level, node_id,
    child_id, child_subtotal)`` where ``level`` is the parent's level."""
    parent = F.lit(0).cast("bigint")
    for lvl in range(grid.dims, 1, -1):
        parent = F.when(F.col("level") == lvl, ancestor("node_id", grid, lvl - 1)).otherwise(parent)
    return tree.where(F.col("level") >= 1).select(
        (F.col("level") - 1).cast("bigint").alias("level"),
        parent.alias("node_id"),
        F.col("node_id").alias("child_id"),
        F.col("subtotal").alias("child_subtotal"),
    )
