"""Checks of a grouping (J1-J3), as jobs over the group and member tables.

Adjacency asks whether every cell of a group has a fellow at squared distance
1. Coordinates are integers, so that holds exactly when one of the cell's 2*D
axis neighbours (inside the grid) is in the same group: the neighbours are
exploded and semi-joined against the members, never all pairs of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilt.functions.grid import Grid, coordinate


def group_balance(groups: DataFrame, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Each group's total against the integer mean of all totals:
    ``(group_id, total, mean, lower, upper, balanced)``. The mean is one
    number (sum and count of the group table), passed back as a literal."""
    s, g = groups.agg(F.sum("total").cast("bigint"), F.count(F.lit(1))).first()
    mean = F.lit(float(s // g) if g else None).cast("double")
    return groups.select(
        "group_id",
        "total",
        mean.alias("mean"),
        (mean * F.lit(low)).alias("lower"),
        (mean * F.lit(high)).alias("upper"),
        ((F.col("total") > mean * F.lit(low)) & (F.col("total") < mean * F.lit(high))).alias("balanced"),
    )


def neighbours(grid: Grid, bin_col: str = "bin_no") -> Column:
    """Array of the cell's axis neighbours that lie inside the grid."""
    out = []
    for i, (s, m) in enumerate(zip(grid.splits, grid.multipliers)):
        c = coordinate(bin_col, grid, i)
        b = F.col(bin_col)
        out.append(F.when(c > 0, b - F.lit(m)))
        out.append(F.when(c < s - 1, b + F.lit(m)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def group_adjacency(members: DataFrame, grid: Grid) -> DataFrame:
    """``(group_id, n_cells, n_isolated, adjacent)``; a cell is isolated
    when no fellow of its group is at squared distance 1."""
    cand = members.select("group_id", "bin_no", F.explode(neighbours(grid)).alias("nb"))
    other = members.select(F.col("group_id").alias("g2"), F.col("bin_no").alias("nb2"))
    linked = (
        cand.join(other, (F.col("group_id") == F.col("g2")) & (F.col("nb") == F.col("nb2")), "left_semi")
        .select("group_id", "bin_no")
        .distinct()
        .withColumn("linked", F.lit(1))
    )
    per_cell = members.select("group_id", "bin_no").join(linked, ["group_id", "bin_no"], "left")
    return per_cell.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum(F.when(F.col("linked").isNull(), 1).otherwise(0)).cast("bigint").alias("n_isolated"),
    ).withColumn("adjacent", F.col("n_isolated") == 0)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared distance of two coordinate arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def coordinates_array(grid: Grid, bin_col: str) -> Column:
    return F.array(*[coordinate(bin_col, grid, i) for i in range(grid.dims)])
