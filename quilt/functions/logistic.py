"""Logistic model arithmetic as Column expressions (and SQL twins).

The dot product is a left-deep sum in feature order; the probability is
``1 / (1 + exp(-w.x))``; a class is 1 when the probability is strictly above
the threshold.

One rule for rows that cannot be scored, in training, in every scorer and in
the SQL twins: a row with a null or non-finite feature is not usable. It takes
no part in training, and its probability, class and vote are null.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quilt.functions.grid import sql_double


def _w(w: float | Column) -> Column:
    return w if isinstance(w, Column) else F.lit(float(w))


def dot(xs: Sequence[Column], ws: Sequence[float | Column]) -> Column:
    out = xs[0] * _w(ws[0])
    for x, w in zip(xs[1:], ws[1:]):
        out = out + x * _w(w)
    return out


def usable(xs: Sequence[Column]) -> Column:
    """All features present and finite (NaN sorts above infinity, so it fails
    the comparison; a null makes the conjunction null, taken as false)."""
    out = F.lit(True)
    for x in xs:
        out = out & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.coalesce(out, F.lit(False))


def dot_array(x: Column, w: Column) -> Column:
    """The same sum over one array column: the plan is as small for thousands of
    features as for two."""
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)


def usable_array(x: Column, width: int) -> Column:
    """``usable`` for features in one array column: all ``width`` of them."""
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(x) == width) & finite, F.lit(False))


def usable_sql(xs: Sequence[str]) -> str:
    return "COALESCE(" + " AND ".join(f"(NOT isnan({x}) AND abs({x}) < CAST('Infinity' AS DOUBLE))" for x in xs) + ", FALSE)"


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def threshold(prob: Column, t: float) -> Column:
    return F.when(prob.isNull(), F.lit(None).cast("double")).when(prob > F.lit(float(t)), 1.0).otherwise(0.0)


def _wsql(w: float | str) -> str:
    return w if isinstance(w, str) else sql_double(float(w))


def dot_sql(xs: Sequence[str], ws: Sequence[float | str]) -> str:
    return "(" + " + ".join(f"{x} * {_wsql(w)}" for x, w in zip(xs, ws)) + ")"


def sigmoid_sql(margin: str) -> str:
    return f"(CAST('1.0' AS DOUBLE) / (CAST('1.0' AS DOUBLE) + exp(-({margin}))))"


def threshold_sql(prob: str, t: float) -> str:
    return f"(CASE WHEN {prob} IS NULL THEN NULL WHEN {prob} > {sql_double(float(t))} THEN CAST('1.0' AS DOUBLE) ELSE CAST('0.0' AS DOUBLE) END)"
