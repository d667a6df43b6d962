"""DuckDB SQL twins of the Spark plans, generated from the same parameters.

These strings are the oracle side of the correctness check; every value that
both sides must compute identically (grid arithmetic, level targets, hash
draws, gradient steps) is produced here by the same formulas, in the same
order of floating-point operations, as on the Spark side.
"""

from __future__ import annotations

from quilt.functions.grid import Grid, coordinate_sql, sql_double
from quilt.functions.logistic import dot_sql, sigmoid_sql, usable_sql
from quilt.operators.grouping import divide_factor


def cte(**parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS (\n{v}\n)" for k, v in parts.items())


def train_sql(points: str, features: list[str], model_expr: str, iterations: int, step: float = 1.0,
              name: str = "w") -> dict[str, str]:
    """CTEs ``{name}_p`` (training rows), ``{name}_n`` (rows per model) and
    ``{name}`` (weights per iteration, column ``it``)."""
    k = len(features)
    p, n = f"{name}_p", f"{name}_n"
    xs = [f"{p}.x{j}" for j in range(k)]
    ws = [f"{name}.w{j}" for j in range(k)]
    resid = f"({sigmoid_sql(dot_sql(xs, ws))} - {p}.label)"
    rate = f"({sql_double(float(step))} / sqrt(CAST({name}.it + 1 AS DOUBLE)))"
    upd = ",\n    ".join(
        f"any_value({name}.w{j}) - {rate} * (sum({resid} * {p}.x{j}) / any_value({n}.n)) AS w{j}" for j in range(k)
    )
    zeros = ", ".join(f"CAST(0.0 AS DOUBLE) AS w{j}" for j in range(k))
    return {
        p: f"SELECT CAST({model_expr} AS BIGINT) AS model_id, label, {', '.join(features)} FROM ({points}) "
        f"WHERE {model_expr} IS NOT NULL AND {usable_sql(features)}",
        n: f"SELECT model_id, count(*) AS n FROM {p} GROUP BY model_id",
        name: f"SELECT 0 AS it, model_id, {zeros} FROM {n}\nUNION ALL\n"
        f"SELECT {name}.it + 1, {name}.model_id,\n    {upd}\n"
        f"FROM {name} JOIN {p} ON {p}.model_id = {name}.model_id JOIN {n} ON {n}.model_id = {name}.model_id\n"
        f"WHERE {name}.it < {iterations}\nGROUP BY {name}.it, {name}.model_id",
    }


def newton_sql(points: str, features: list[str], iterations: int, l2: float, name: str = "nw") -> dict[str, str]:
    """CTEs ``{name}_p`` (training rows), ``{name}_n`` and ``{name}`` (it, w0, ..):
    Newton steps on the mean logistic loss with a ridge. The k equations of a step
    are eliminated and solved back in nested selects, a level for each unknown."""
    k = len(features)
    p = f"{name}_p"
    margin = dot_sql([f"{p}.{c}" for c in features], [f"{name}.w{j}" for j in range(k)])
    ridge = sql_double(float(l2))
    prob = sigmoid_sql(margin)
    ws = [f"w{j}" for j in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [f"any_value({name}.{w}) AS {w}" for w in ws]
    sums += [f"sum(({prob} - {p}.label) * {p}.{c}) / count(*) + {ridge} * any_value({name}.w{j}) AS g{j}" for j, c in enumerate(features)]
    sums += [
        f"sum({prob} * (CAST(1.0 AS DOUBLE) - {prob}) * {p}.{features[i]} * {p}.{features[j]}) / count(*)"
        + (f" + {ridge}" if i == j else "") + f" AS h{i}_{j}"
        for i, j in cells
    ]
    inner = f"SELECT {name}.it, {', '.join(sums)} FROM {name} CROSS JOIN {p} WHERE {name}.it < {iterations} GROUP BY {name}.it"
    for c in range(k):  # the matrix is symmetric: only its upper half is kept
        cols = [*ws, *[f"g{j}" if j <= c else f"g{j} - h{c}_{j} / h{c}_{c} * g{c} AS g{j}" for j in range(k)]]
        cols += [f"h{i}_{j}" if i <= c else f"h{i}_{j} - h{c}_{i} / h{c}_{c} * h{c}_{j} AS h{i}_{j}" for i, j in cells]
        inner = f"SELECT it, {', '.join(cols)} FROM ({inner})"
    for c in range(k - 1, -1, -1):
        rest = "".join(f" - h{c}_{j} * d{j}" for j in range(c + 1, k))
        keep = [*ws, *[f"g{j}" for j in range(c)], *[f"h{i}_{j}" for i, j in cells if i < c], *[f"d{j}" for j in range(c + 1, k)]]
        inner = f"SELECT it, {', '.join(keep)}, (g{c}{rest}) / h{c}_{c} AS d{c} FROM ({inner})"
    step = ", ".join(f"{w} - d{j} AS {w}" for j, w in enumerate(ws))
    zeros = ", ".join(f"CAST(0.0 AS DOUBLE) AS {w}" for w in ws)
    return {
        p: f"SELECT label, {', '.join(features)} FROM ({points}) WHERE {usable_sql(features)}",
        f"{name}_n": f"SELECT count(*) AS n FROM {p}",
        name: f"SELECT 0 AS it, {zeros} FROM {name}_n WHERE n > 0\nUNION ALL\nSELECT it + 1, {step} FROM ({inner})",
    }


def targets_sql(cells: str, grid: Grid, n_groups: int, weight: str = "n") -> str:
    """One row: ``q0..q{D-1}``, the level targets by repeated division."""
    f = sql_double(divide_factor(n_groups, grid.dims))
    q, cols = f"CAST(sum({weight}) AS DOUBLE)", []
    for lvl in range(grid.dims):
        q = f"{q} / {f}"
        cols.append(f"COALESCE({q}, CAST(0.0 AS DOUBLE)) AS q{lvl}")
    return f"SELECT {', '.join(cols)} FROM {cells}"


def grouping_sql(cells: str, grid: Grid, n_groups: int, pre: str = "g", weight: str = "n") -> dict[str, str]:
    """CTEs for the equi-depth grouping of ``cells (bin_no, weight)``.

    Produces ``{pre}_runs{l}`` (path, s, e, tot) per level, ``{pre}_seg{l}``
    (p, k, np) routing tables, ``{pre}_groups`` (group_id, group_key, lo/hi
    per axis, total) and ``{pre}_segl`` (p, k, group_id) for the last level.
    The greedy walk along an axis is a recursive CTE over the coordinates.
    """
    d = grid.dims
    mult = grid.multipliers
    out: dict[str, str] = {}
    tg = f"{pre}_tg"
    base = f"{pre}_c"
    coords = ", ".join(f"{coordinate_sql('bin_no', grid, i)} AS c{i}" for i in range(d))
    out[base] = f"SELECT CAST({weight} AS BIGINT) AS w, {coords} FROM {cells} WHERE bin_no IS NOT NULL"
    out[tg] = targets_sql(base, grid, n_groups, "w")
    prev_cells = f"{pre}_c0p"
    out[prev_cells] = f"SELECT CAST(0 AS BIGINT) AS path, * FROM {base}"
    prev_boxes = None
    for lvl in range(d):
        s = grid.splits[lvl]
        per, dense, st, runs, boxes = (f"{pre}_per{lvl}", f"{pre}_dense{lvl}", f"{pre}_st{lvl}",
                                       f"{pre}_runs{lvl}", f"{pre}_boxes{lvl}")
        out[per] = f"SELECT path, c{lvl} AS c, sum(w) AS w FROM {prev_cells} GROUP BY path, c{lvl}"
        out[dense] = (
            f"SELECT p.path, r.i, COALESCE(x.w, 0) AS a FROM (SELECT DISTINCT path FROM {per}) p "
            f"CROSS JOIN range(0, {s + 1}) r(i) LEFT JOIN {per} x ON x.path = p.path AND x.c = r.i"
        )
        q = f"{tg}.q{lvl}"
        t2 = f"(st.t + a.a)"
        x = "b.a"
        close = f"(({t2} > {q}) OR (({t2} <= {q}) AND ({q} < {t2} + {x}) AND (({q} - {t2}) < ({t2} + {x} - {q}))))"
        out[st] = (
            f"SELECT path, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS s, "
            f"CAST(NULL AS BIGINT) AS cs, CAST(NULL AS BIGINT) AS ce, CAST(NULL AS BIGINT) AS ctot "
            f"FROM (SELECT DISTINCT path FROM {per})\nUNION ALL\n"
            f"SELECT st.path, st.i + 1, CASE WHEN {close} THEN 0 ELSE {t2} END, "
            f"CASE WHEN {close} THEN st.i + 1 ELSE st.s END, "
            f"CASE WHEN {close} THEN st.s END, CASE WHEN {close} THEN st.i END, CASE WHEN {close} THEN {t2} END\n"
            f"FROM {st} st JOIN {dense} a ON a.path = st.path AND a.i = st.i "
            f"JOIN {dense} b ON b.path = st.path AND b.i = st.i + 1 CROSS JOIN {tg}\n"
            f"WHERE st.i < {s}"
        )
        out[runs] = (
            f"SELECT path, cs AS s, ce AS e, ctot AS tot FROM {st} WHERE cs IS NOT NULL\nUNION ALL\n"
            f"SELECT path, s, CAST({s - 1} AS BIGINT) AS e, t AS tot FROM {st} WHERE i = {s} AND t > 0"
        )
        prev_bounds = "".join(f", b.lo{i}, b.hi{i}" for i in range(lvl))
        join_prev = f" JOIN {prev_boxes} b ON b.path = r.path" if prev_boxes else ""
        out[boxes] = (
            f"SELECT r.path + r.s * {mult[lvl]} AS path{prev_bounds}, r.s AS lo{lvl}, r.e AS hi{lvl}, r.tot "
            f"FROM {runs} r{join_prev}"
        )
        prev_boxes = boxes
        if lvl < d - 1:
            seg = f"{pre}_seg{lvl}"
            out[seg] = (
                f"SELECT path AS p, CAST(unnest(generate_series(s, e)) AS BIGINT) AS k, path + s * {mult[lvl]} AS np "
                f"FROM {runs}"
            )
            nxt = f"{pre}_c{lvl + 1}p"
            cs = ", ".join(f"x.c{i}" for i in range(d))
            out[nxt] = f"SELECT g.np AS path, x.w, {cs} FROM {prev_cells} x JOIN {seg} g ON g.p = x.path AND g.k = x.c{lvl}"
            prev_cells = nxt
    bounds = ", ".join(f"lo{i}, hi{i}" for i in range(d))
    out[f"{pre}_groups"] = (
        f"SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS group_id, path AS group_key, {bounds}, "
        f"CAST(tot AS BIGINT) AS total FROM {prev_boxes}"
    )
    last = d - 1
    out[f"{pre}_segl"] = (
        f"SELECT s.p, s.k, gr.group_id FROM (SELECT path AS p, CAST(unnest(generate_series(s, e)) AS BIGINT) AS k, "
        f"path + s * {mult[last]} AS group_key FROM {pre}_runs{last}) s JOIN {pre}_groups gr ON gr.group_key = s.group_key"
    )
    return out


def route_sql(rows: str, grid: Grid, pre: str = "g", compatible: bool = True, bin_col: str = "bin_no") -> str:
    """SELECT over ``rows`` adding ``group_id`` by the D routing joins."""
    d = grid.dims
    joins, path = [], "CAST(0 AS BIGINT)"
    for lvl in range(d - 1):
        a = f"r{lvl}"
        joins.append(
            f"LEFT JOIN {pre}_seg{lvl} {a} ON {a}.p = {path} AND {a}.k = {coordinate_sql('z.' + bin_col, grid, lvl)}"
        )
        path = f"{a}.np"
    joins.append(
        f"LEFT JOIN {pre}_segl rl ON rl.p = {path} AND rl.k = {coordinate_sql('z.' + bin_col, grid, d - 1)}"
    )
    gid = f"CASE WHEN z.{bin_col} IS NULL THEN NULL ELSE COALESCE(rl.group_id, 0) END" if compatible else "rl.group_id"
    return f"SELECT z.*, CAST({gid} AS BIGINT) AS group_id FROM {rows} z " + " ".join(joins)
