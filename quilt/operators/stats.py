"""Per-feature minimum and maximum.

NaN never wins a comparison in the reference's loop, so NaN is skipped; nulls
are skipped too; an empty input reports (+inf, -inf), the loop's start values.
One pass, any width: a single aggregate over all feature columns for flat
points, or posexplode + grouped aggregate (partial per task) for an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def _clean(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def feature_min_max(points: DataFrame, cols: list[str]) -> DataFrame:
    """``(feature, min_value, max_value)``, one row per column."""
    aggs = []
    for c in cols:
        aggs.append(F.coalesce(F.min(_clean(F.col(c))), F.lit(INF)).alias(f"mn_{c}"))
        aggs.append(F.coalesce(F.max(_clean(F.col(c))), F.lit(-INF)).alias(f"mx_{c}"))
    wide = points.agg(*aggs)
    stack = ", ".join(f"'{c}', `mn_{c}`, `mx_{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, min_value, max_value)")


def feature_min_max_array(df: DataFrame, array_col: str, prefix: str = "x") -> DataFrame:
    """The same over an ``array<double|float>`` column of any width. The
    exploded rows never leave the task: the aggregate is partial before the
    shuffle, which carries one row per position per task."""
    ex = df.select(F.posexplode(array_col).alias("pos", "v")).select("pos", F.col("v").cast("double").alias("v"))
    return ex.groupBy("pos").agg(
        F.coalesce(F.min(_clean(F.col("v"))), F.lit(INF)).alias("min_value"),
        F.coalesce(F.max(_clean(F.col("v"))), F.lit(-INF)).alias("max_value"),
    ).select(F.concat(F.lit(prefix), F.col("pos").cast("string")).alias("feature"), "min_value", "max_value")


def grid_from_min_max(min_max_rows: list, columns: list[str], splits: list[int]):
    """A grid whose bounds are measured minima and maxima (a few numbers
    collected from C1). The maximum itself falls in the last split (clamp)."""
    from quilt.functions.grid import Grid

    found = {r["feature"]: (r["min_value"], r["max_value"]) for r in min_max_rows}
    return Grid.of(*[(c, found[c][0], found[c][1], s) for c, s in zip(columns, splits)])
