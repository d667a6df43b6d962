"""Grid over feature columns: spec, cell numbering and coordinates.

Axis i has bounds ``lo``, ``hi`` and ``splits`` S_i. The split of a value is
``trunc((v - lo) * S / (hi - lo))``; the cell number is the mixed-radix sum
``sum(split_i * m_i)`` with ``m_i = prod(S_j for j > i)``, so the first axis is
the most significant digit. Everything here builds Column expressions (JVM
side, whole-stage codegen); the spec itself is a few numbers on the driver
that become literals.

Each builder has a twin ``*_sql`` producing the same arithmetic as SQL text for
the DuckDB oracle; both are generated from one spec so they cannot drift.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

POLICIES = ("clamp", "raw", "null")
INT_MAX = 2**31 - 1
INT_MIN = -(2**31)


def sql_double(x: float) -> str:
    """A DOUBLE literal that DuckDB parses exactly (plain decimals are DECIMAL)."""
    if math.isnan(x):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(x):
        return "CAST('Infinity' AS DOUBLE)" if x > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"CAST('{x!r}' AS DOUBLE)"


@dataclass(frozen=True)
class Axis:
    column: str
    lo: float
    hi: float
    splits: int

    def __post_init__(self) -> None:
        if not isinstance(self.splits, int) or self.splits < 1:
            raise ValueError(f"axis {self.column}: splits must be a positive int")
        if math.isnan(self.lo) or math.isnan(self.hi) or not self.hi > self.lo:
            raise ValueError(f"axis {self.column}: need hi > lo, got [{self.lo}, {self.hi}]")


@dataclass(frozen=True)
class Grid:
    axes: tuple[Axis, ...]

    def __post_init__(self) -> None:
        if not self.axes:
            raise ValueError("a grid needs at least one axis")
        names = [a.column for a in self.axes]
        if len(set(names)) != len(names):
            raise ValueError(f"duplicate grid column in {names}")
        if math.prod(a.splits for a in self.axes) >= 2**63:
            raise ValueError("number of cells overflows bigint")

    @staticmethod
    def of(*axes: tuple[str, float, float, int]) -> "Grid":
        return Grid(tuple(Axis(c, float(lo), float(hi), int(s)) for c, lo, hi, s in axes))

    def add(self, column: str, lo: float, hi: float, splits: int) -> "Grid":
        """A new grid with one more, least significant, axis."""
        return Grid(self.axes + (Axis(column, float(lo), float(hi), int(splits)),))

    @property
    def dims(self) -> int:
        return len(self.axes)

    @property
    def splits(self) -> list[int]:
        return [a.splits for a in self.axes]

    @property
    def multipliers(self) -> list[int]:
        out, m = [], 1
        for a in reversed(self.axes):
            out.append(m)
            m *= a.splits
        return out[::-1]

    @property
    def cells(self) -> int:
        return math.prod(self.splits)

    def prefix_cells(self, level: int) -> int:
        """Number of distinct coordinate prefixes of length ``level + 1``."""
        return math.prod(self.splits[: level + 1])


# ---------------------------------------------------------------- splits


def _ratio(x: Column, a: Axis) -> Column:
    return ((x - F.lit(a.lo)) * F.lit(float(a.splits))) / F.lit(a.hi - a.lo)


def axis_split(x: Column, a: Axis, policy: str = "clamp") -> Column:
    """Split index of ``x`` on axis ``a`` as bigint.

    clamp: NaN -> 0, below range -> 0, at or above ``hi`` -> S-1.
    raw:   the plain truncating formula with Java int saturation (NaN -> 0).
    null:  values outside [lo, hi) and NaN give null (row is unroutable).
    A null feature gives a null split under every policy.
    """
    t = _ratio(x, a)
    s = a.splits
    if policy == "clamp":
        return (
            F.when(F.isnan(t), F.lit(0).cast("bigint"))
            .when(t < 0, F.lit(0).cast("bigint"))
            .when(t >= float(s), F.lit(s - 1).cast("bigint"))
            .otherwise(t.cast("bigint"))
        )
    if policy == "raw":
        return (
            F.when(F.isnan(t), F.lit(0).cast("bigint"))
            .when(t >= float(INT_MAX), F.lit(INT_MAX).cast("bigint"))
            .when(t <= float(INT_MIN), F.lit(INT_MIN).cast("bigint"))
            .otherwise(t.cast("bigint"))
        )
    if policy == "null":
        return F.when(F.isnan(t) | (t < 0) | (t >= float(s)), F.lit(None).cast("bigint")).otherwise(
            t.cast("bigint")
        )
    raise ValueError(f"unknown policy {policy!r}; one of {POLICIES}")


def axis_split_sql(x: str, a: Axis, policy: str = "clamp", lo: str | None = None, hi: str | None = None) -> str:
    """SQL twin of :func:`axis_split`; ``lo``/``hi`` may name columns holding
    bounds measured in the same query (then ``hi - lo`` is computed there)."""
    width = f"(({hi}) - ({lo}))" if lo is not None else sql_double(a.hi - a.lo)
    lo = f"({lo})" if lo is not None else sql_double(a.lo)
    t = f"((({x}) - {lo}) * {sql_double(float(a.splits))}) / {width}"
    s = a.splits
    if policy == "clamp":
        return (
            f"(CASE WHEN isnan({t}) THEN 0::BIGINT WHEN {t} < 0 THEN 0::BIGINT "
            f"WHEN {t} >= {sql_double(float(s))} THEN {s - 1}::BIGINT ELSE trunc({t})::BIGINT END)"
        )
    if policy == "raw":
        return (
            f"(CASE WHEN isnan({t}) THEN 0::BIGINT WHEN {t} >= {sql_double(float(INT_MAX))} THEN {INT_MAX}::BIGINT "
            f"WHEN {t} <= {sql_double(float(INT_MIN))} THEN ({INT_MIN})::BIGINT ELSE trunc({t})::BIGINT END)"
        )
    if policy == "null":
        return (
            f"(CASE WHEN isnan({t}) OR {t} < 0 OR {t} >= {sql_double(float(s))} THEN NULL "
            f"ELSE trunc({t})::BIGINT END)"
        )
    raise ValueError(f"unknown policy {policy!r}")


# ------------------------------------------------------------ cell number


def bin_no(grid: Grid, policy: str = "clamp", cols: Sequence[Column] | None = None) -> Column:
    """Cell number of a row: sum of split * multiplier (bigint)."""
    cols = cols or [F.col(a.column) for a in grid.axes]
    terms = [axis_split(c, a, policy) * F.lit(m) for c, a, m in zip(cols, grid.axes, grid.multipliers)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def bin_no_sql(grid: Grid, policy: str = "clamp", cols: Sequence[str] | None = None) -> str:
    cols = cols or [a.column for a in grid.axes]
    return "(" + " + ".join(
        f"{axis_split_sql(c, a, policy)} * {m}" for c, a, m in zip(cols, grid.axes, grid.multipliers)
    ) + ")"


def coordinate(bin_col: str, grid: Grid, i: int) -> Column:
    """Coordinate ``i`` of cell number column ``bin_col`` (non-negative ids):
    ``bin div m_0`` on the first axis, ``(bin div m_i) % S_i`` after it."""
    return F.expr(coordinate_sql(bin_col, grid, i, dialect="spark"))


def coordinate_sql(bin_col: str, grid: Grid, i: int, dialect: str = "duckdb") -> str:
    m = grid.multipliers[i]
    div = "div" if dialect == "spark" else "//"
    q = f"({bin_col})" if m == 1 else f"(({bin_col}) {div} {m})"
    return q if i == 0 else f"({q} % {grid.splits[i]})"


def ancestor(bin_col: str, grid: Grid, level: int) -> Column:
    """Id of the level-``level`` tree node holding the cell: coordinates from
    ``level`` on set to 0; level 0 is the root (id 0)."""
    return F.expr(ancestor_sql(bin_col, grid, level))


def ancestor_sql(bin_col: str, grid: Grid, level: int) -> str:
    if level == 0:
        return "CAST(0 AS BIGINT)"
    m = grid.multipliers[level - 1]
    return f"(({bin_col}) - (({bin_col}) % {m}))"
