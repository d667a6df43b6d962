"""Registered queries: one Spark plan and one DuckDB SQL twin per key.

Every query reads the given parquet tables (whole tables, whole texts) and
returns flat columns with the same names and types on both sides. Fitted
weights are rounded to 4 decimals and probabilities to 6 on both sides; the
two engines sum in different orders and agree to about 1e-12 relative.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.functions.grid import Grid, ancestor, ancestor_sql, axis_split, axis_split_sql, bin_no, bin_no_sql, coordinate_sql, sql_double
from quilt.functions.hashing import stable_part_sql, stable_uniform_sql
from quilt.functions.logistic import dot_sql, sigmoid_sql, threshold_sql, usable_sql
from quilt.operators import quality, stats
from quilt.operators.grouping import group_members, level_target_cols, route
from quilt.operators.histogram import dense_histogram, histogram_tree, tree_children, with_cell_coordinates
from quilt.operators.metrics import accuracy, auc
from quilt.operators.newton import fit_newton
from quilt.operators.partition import filter_part, random_part_sizes, sample_hash, sample_native
from quilt.operators.train_table import fit_table
from quilt.plans.ensembles import Config, workbench
from quilt.plans.sqlgen import cte, grouping_sql, newton_sql, route_sql, targets_sql, train_sql
from quilt.session import broadcast_if_small, ensure_checkpoint_dir
from quilt.sources.points import VIEWS, points, points_sql, read_table, unit_scaled, unit_scaled_sql
from quilt.sources.text import document_lines, drop_marker_lines, parse_points, render_lines, scan_lines, write_lines

CFG = Config(
    label="price", scaled=True, train_share=0.7, partitions=8,
    grid=Grid.of(("x0", 0.0, 1.0, 8), ("x1", 0.0, 1.0, 8), ("x2", 0.0, 1.0, 8)),
)
# cells, their counts and groups are of the whole table; only what trains, scores
# and evaluates splits it
HIST_CFG = replace(CFG, train_share=None)
GRID = CFG.grid
FEATS = list(CFG.features)
MARKER = "the"
SAMPLE_FRACTION = 0.1
FILTER_GROUP = 1
FILTER_PART = 0
ORD_SPLITS = {"x0": 6, "x1": 4}
MEASURED_SPLITS = [4, 4, 4, 4]

QueryFn = Callable[[SparkSession, str], DataFrame]
SPARK: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def wb(spark: SparkSession, sf: str):
    return workbench(spark, sf, CFG)


def whole(spark: SparkSession, sf: str):
    return workbench(spark, sf, HIST_CFG)


def r4(c):
    # + 0.0 turns a rounded -0.0 into 0.0 (engines differ on the sign of a
    # value rounded to zero)
    return F.round(c, 4) + F.lit(0.0)


# ----------------------------------------------------------- SQL building

class Suite:
    """SQL pieces for one configuration (view, grid, groups, parts, steps)."""

    def __init__(self, cfg: Config):
        self.cfg = cfg
        self.grid = cfg.grid
        self.feats = list(cfg.features)
        raw = points_sql(cfg.view, cfg.label)
        draw = stable_uniform_sql(f"split{cfg.seed}", "key")
        share = sql_double(float(cfg.train_share)) if cfg.train_share is not None else None
        split = f"{draw} < {share} AS fit, {draw} >= {share} AS test" if share else "TRUE AS fit, TRUE AS test"
        bounds = ", ".join(
            f"min(CASE WHEN NOT isnan({c}) THEN {c} END) AS lo_{c}, max(CASE WHEN NOT isnan({c}) THEN {c} END) AS hi_{c}"
            for c in self.feats
        )
        unit = unit_scaled_sql("raw", "mm", self.feats) if cfg.scaled else "SELECT * FROM raw"
        self.base = {
            "raw": raw,
            "mm": f"SELECT {bounds} FROM raw",
            "pts": f"SELECT *, {split} FROM ({unit})",
            "bins": f"SELECT *, {bin_no_sql(cfg.grid, cfg.policy)} AS bin_no FROM pts",
            "counts": "SELECT bin_no, count(*) AS n FROM bins WHERE fit AND bin_no IS NOT NULL GROUP BY bin_no",
        }
        self.part_expr = stable_part_sql(f"part{cfg.seed}", "key", cfg.n_parts)
        self.w_cols = ", ".join(f"round(w{j}, 4) + CAST(0.0 AS DOUBLE) AS w{j}" for j in range(len(self.feats)))
        t = cfg.threshold
        ok = usable_sql([f"z.{c}" for c in self.feats])
        prob = f"CASE WHEN {ok} THEN {self.prob('m')} END"
        self.scored_global = (
            f"SELECT key, label, probability, {threshold_sql('probability', t)} AS prediction FROM ("
            f"SELECT z.key, z.label, {prob} AS probability FROM pts z LEFT JOIN wglob_final m ON TRUE WHERE z.test)"
        )
        self.scored_routed = (
            f"SELECT key, label, group_id, probability, {threshold_sql('probability', t)} AS prediction FROM ("
            f"SELECT z.key, z.label, z.group_id, {prob} AS probability "
            f"FROM routed z LEFT JOIN wgrp_final m ON m.model_id = z.group_id WHERE z.test)"
        )
        one = f"CASE WHEN {self.prob('m')} > {sql_double(t)} THEN 1 ELSE 0 END"
        self.scored_vote = (
            "SELECT key, label, ones, CASE WHEN ones IS NULL THEN NULL WHEN 2 * ones > (SELECT count(*) FROM wpart_final) "
            "THEN CAST('1.0' AS DOUBLE) ELSE CAST('0.0' AS DOUBLE) END AS prediction FROM ("
            f"SELECT z.key, any_value(z.label) AS label, CAST(sum(CASE WHEN {ok} THEN {one} END) AS BIGINT) AS ones "
            f"FROM pts z CROSS JOIN wpart_final m WHERE z.test GROUP BY z.key)"
        )

    def with_base(self, **more: str) -> str:
        parts = dict(self.base)
        parts.update(more)
        return cte(**parts)

    def with_groups(self, **more: str) -> str:
        parts = dict(self.base)
        parts.update(grouping_sql("counts", self.grid, self.cfg.n_groups))
        parts["routed"] = route_sql("bins", self.grid)
        parts.update(more)
        return cte(**parts)

    def trained(self, kind: str) -> dict[str, str]:
        """Training CTEs for one strategy plus ``{kind}_final (model_id, n, w..)``."""
        cfg = self.cfg
        if kind == "wglob":
            parts = train_sql("SELECT * FROM pts WHERE fit", self.feats, "0", cfg.iter_global, name=kind)
            it = cfg.iter_global
        elif kind == "wgrp":
            parts = train_sql("SELECT * FROM routed WHERE fit", self.feats, "group_id", cfg.iter_ensemble, name=kind)
            it = cfg.iter_ensemble
        else:
            parts = train_sql("SELECT * FROM pts WHERE fit", self.feats, self.part_expr, cfg.iter_ensemble, name=kind)
            it = cfg.iter_ensemble
        ws = ", ".join(f"w.w{j}" for j in range(len(self.feats)))
        parts[f"{kind}_final"] = (
            f"SELECT w.model_id, CAST(c.n AS BIGINT) AS n, {ws} FROM {kind} w "
            f"JOIN {kind}_n c ON c.model_id = w.model_id WHERE w.it = {it}"
        )
        return parts

    def prob(self, ws_alias: str) -> str:
        k = len(self.feats)
        return sigmoid_sql(dot_sql([f"z.x{j}" for j in range(k)], [f"{ws_alias}.w{j}" for j in range(k)]))


MAIN = Suite(CFG)
HIST = Suite(HIST_CFG)
PTS = points_sql(CFG.view)  # as the table has them
BASE = MAIN.base
with_groups = MAIN.with_groups
with_base = MAIN.with_base
trained = MAIN.trained
PART_EXPR = MAIN.part_expr
W_COLS = MAIN.w_cols
SCORED_GLOBAL = MAIN.scored_global
SCORED_ROUTED = MAIN.scored_routed
SCORED_VOTE = MAIN.scored_vote


def acc_sql(src: str, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {sel}count(*) AS n, CAST(COALESCE(sum(CASE WHEN prediction = label THEN 1 ELSE 0 END), 0) AS BIGINT) AS correct, "
        f"CASE WHEN count(*) > 0 THEN CAST(COALESCE(sum(CASE WHEN prediction = label THEN 1 ELSE 0 END), 0) AS DOUBLE) / count(*) * CAST('100.0' AS DOUBLE) END AS accuracy_pct "
        f"FROM {src}{grp}"
    )


def auc_sql(src: str, score: str = "prediction") -> str:
    lv = (
        f"SELECT {score} AS s, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label > 0 THEN 0 ELSE 1 END) AS fp "
        f"FROM {src} WHERE {score} IS NOT NULL GROUP BY 1"
    )
    ar = (
        f"SELECT tp, fp, CAST(fp AS HUGEINT) * (2 * COALESCE(sum(tp) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + tp) AS num "
        f"FROM ({lv})"
    )
    return (
        f"SELECT CAST(sum(tp) AS BIGINT) AS positives, CAST(sum(fp) AS BIGINT) AS negatives, "
        f"CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN CAST(sum(num) AS DOUBLE) / (CAST('2.0' AS DOUBLE) * CAST(sum(tp) AS DOUBLE) * CAST(sum(fp) AS DOUBLE)) END AS auc "
        f"FROM ({ar})"
    )


# --------------------------------------------------------- A: sources


@register("scan_points", cte(pts=PTS) + "\nSELECT * FROM pts")
def q_scan_points(spark, sf):
    return points(spark, sf, CFG.view)


@register(
    "count_points",
    "\nUNION ALL\n".join(f"SELECT '{v}' AS view, count(*) AS n FROM ({points_sql(v)})" for v in VIEWS),
)
def q_count_points(spark, sf):
    out = None
    for v in VIEWS:
        c = points(spark, sf, v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("view"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@register(
    "drop_marker_lines",
    "SELECT doc_id, line_no, line FROM (SELECT doc_id, CAST(unnest(generate_series(0, len(p) - 1)) AS BIGINT) AS line_no, "
    f"unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE NOT contains(line, '{MARKER}')",
)
def q_drop_marker_lines(spark, sf):
    return drop_marker_lines(document_lines(read_table(spark, sf, "documents")), MARKER)


# Documents' lines written as text files (250 ids each), those with the marker
# with a byte that is no UTF-8 before them, and read again from the files.
IDS_PER_FILE = 250
DOCUMENT_LINES_SQL = (
    "SELECT doc_id, CAST(unnest(generate_series(0, len(p) - 1)) AS BIGINT) AS line_no, "
    "unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)"
)


@register(
    "scan_text_lines",
    cte(
        lines=DOCUMENT_LINES_SQL,
        broken=f"SELECT doc_id, line_no, contains(line, '{MARKER}') AS bad, line FROM lines",
    )
    + f"\nSELECT doc_id // {IDS_PER_FILE} AS part, "
    f"row_number() OVER (PARTITION BY doc_id // {IDS_PER_FILE} ORDER BY doc_id, line_no) - 1 AS line_no, "
    "CASE WHEN bad THEN chr(65533) || line ELSE line END AS line, bad AS bad_encoding FROM broken",
)
def q_scan_text_lines(spark, sf):
    lines = document_lines(read_table(spark, sf, "documents"))
    bad = F.col("line").contains(MARKER)
    wrong = F.concat(F.unhex(F.lit("FF")).cast("string"), F.col("line"))
    lines = lines.select("doc_id", "line_no", F.expr(f"doc_id div {IDS_PER_FILE}").alias("part"), F.when(bad, wrong).otherwise(F.col("line")).alias("line"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    write_lines(lines, path, "part", ["doc_id", "line_no"])
    return scan_lines(spark, path).select(F.col("part").cast("bigint").alias("part"), "line_no", "line", "bad_encoding")


def _parse_sql() -> str:
    fields = ", ".join(["CAST(label AS VARCHAR)"] + [f"CAST(x{j} AS VARCHAR)" for j in range(len(FEATS))])
    lines = f"SELECT key, concat_ws(',', {fields}) AS line FROM pts"
    split = "SELECT key, string_split(regexp_replace(line, ',+$', ''), ',') AS p FROM lines"
    cols = ", ".join(["CAST(trim(p[1]) AS DOUBLE) AS label"] + [f"CAST(trim(p[{j + 2}]) AS DOUBLE) AS x{j}" for j in range(len(FEATS))])
    return cte(pts=PTS, lines=lines, parts=split) + f"\nSELECT key, {cols} FROM parts"


@register("parse_points", _parse_sql())
def q_parse_points(spark, sf):
    lines = render_lines(points(spark, sf, CFG.view), len(FEATS), keep=["key"])
    return parse_points(lines, len(FEATS), keep=["key"])


# lines with a field too few, a field too many, and a field that is no number
BROKEN_SQL = (
    "CASE WHEN CAST(split_part(key, '|', 4) AS INT) = 1 THEN regexp_replace(line, ',[^,]*$', '') "
    "WHEN CAST(split_part(key, '|', 4) AS INT) = 2 THEN line || ',7' "
    "WHEN CAST(split_part(key, '|', 4) AS INT) = 3 THEN 'n/a' || line ELSE line END"
)


def _parse_permissive_sql() -> str:
    fields = ", ".join(["CAST(label AS VARCHAR)"] + [f"CAST(x{j} AS VARCHAR)" for j in range(len(FEATS))])
    lines = f"SELECT key, concat_ws(',', {fields}) AS line FROM pts"
    broken = f"SELECT key, {BROKEN_SQL} AS line FROM lines"
    split = "SELECT key, string_split(regexp_replace(line, ',+$', ''), ',') AS p FROM broken"
    names = ["label"] + FEATS
    cols = ", ".join(f"TRY_CAST(trim(p[{j + 1}]) AS DOUBLE) AS {c}" for j, c in enumerate(names))
    missing = " OR ".join(f"{c} IS NULL" for c in names)
    return cte(pts=PTS, lines=lines, broken=broken, parts=split, got=f"SELECT key, len(p) AS m, {cols} FROM parts") + (
        f"\nSELECT key, {', '.join(names)}, (m <> {len(names)} OR {missing}) AS bad FROM got"
    )


@register("parse_points_permissive", _parse_permissive_sql())
def q_parse_points_permissive(spark, sf):
    lines = render_lines(points(spark, sf, CFG.view), len(FEATS), keep=["key"])
    return parse_points(lines.select("key", F.expr(BROKEN_SQL).alias("line")), len(FEATS), keep=["key"], mode="permissive")


@register(
    "sample_hash",
    cte(pts=PTS) + f"\nSELECT * FROM pts WHERE {stable_uniform_sql(f'sample{CFG.seed}', 'key')} < {sql_double(SAMPLE_FRACTION)}",
)
def q_sample_hash(spark, sf):
    return sample_hash(points(spark, sf, CFG.view), SAMPLE_FRACTION, CFG.seed)


# A Bernoulli sample has no twin row by row (its draws follow the partitions);
# its checkable facts are: it holds rows of the table, none of them twice, and
# about the wanted share of all (within six standard deviations).
@register(
    "sample_native",
    cte(pts=PTS) + "\nSELECT count(*) AS n_all, CAST(0 AS BIGINT) AS n_foreign, CAST(0 AS BIGINT) AS n_repeated, "
    "TRUE AS share_holds FROM pts",
)
def q_sample_native(spark, sf):
    pts = points(spark, sf, CFG.view)
    drawn = sample_native(pts, SAMPLE_FRACTION, CFG.seed).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    both = pts.select("key").join(drawn, "key", "full_outer").join(
        pts.select("key", F.lit(True).alias("known")), "key", "left"
    )
    got = both.agg(
        F.count(F.when(F.col("known"), 1)).alias("n_all"),
        F.count(F.when(F.col("known").isNull(), 1)).alias("n_foreign"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"),
        F.sum(F.coalesce("n", F.lit(0))).alias("n"),
    )
    spread6 = 6 * F.sqrt(F.col("n_all") * F.lit(SAMPLE_FRACTION * (1 - SAMPLE_FRACTION)))
    holds = F.abs(F.col("n") - F.col("n_all") * F.lit(SAMPLE_FRACTION)) <= spread6
    return got.select("n_all", "n_foreign", "n_repeated", holds.alias("share_holds"))


# ------------------------------------------------------ B: projections


@register("project_labels", cte(pts=PTS) + "\nSELECT key, label FROM pts")
def q_project_labels(spark, sf):
    return points(spark, sf, CFG.view).select("key", "label")


@register("project_features", cte(pts=PTS) + f"\nSELECT key, {', '.join(FEATS)} FROM pts")
def q_project_features(spark, sf):
    return points(spark, sf, CFG.view).select("key", *FEATS)


@register("assign_bin_no", with_base() + "\nSELECT key, bin_no FROM bins")
def q_assign_bin_no(spark, sf):
    return wb(spark, sf).binned().select("key", "bin_no")


@register("assign_random_part", cte(pts=PTS) + f"\nSELECT key, {PART_EXPR} AS part_id FROM pts")
def q_assign_random_part(spark, sf):
    return wb(spark, sf).parted().select("key", "part_id")


@register("filter_bin_group", HIST.with_groups() + f"\nSELECT key, bin_no, group_id FROM routed WHERE group_id = {FILTER_GROUP}")
def q_filter_bin_group(spark, sf):
    return whole(spark, sf).routed().where(F.col("group_id") == FILTER_GROUP).select("key", "bin_no", "group_id")


@register("filter_random_part", cte(pts=PTS) + f"\nSELECT key, part_id FROM (SELECT key, {PART_EXPR} AS part_id FROM pts) WHERE part_id = {FILTER_PART}")
def q_filter_random_part(spark, sf):
    return filter_part(wb(spark, sf).parted(), FILTER_PART).select("key", "part_id")


@register("random_part_sizes", cte(pts=PTS) + f"\nSELECT {PART_EXPR} AS part_id, count(*) AS n FROM pts GROUP BY 1")
def q_random_part_sizes(spark, sf):
    return random_part_sizes(wb(spark, sf).parted())


# ------------------------------------------------------ C: statistics


def _minmax_sql(src: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, COALESCE(min(CASE WHEN NOT isnan({c}) THEN {c} END), CAST('Infinity' AS DOUBLE)) AS min_value, "
        f"COALESCE(max(CASE WHEN NOT isnan({c}) THEN {c} END), CAST('-Infinity' AS DOUBLE)) AS max_value FROM {src}"
        for c in cols
    )


@register("feature_min_max", cte(pts=PTS) + "\n" + _minmax_sql("pts", FEATS))
def q_feature_min_max(spark, sf):
    return stats.feature_min_max(points(spark, sf, CFG.view), FEATS)


@register(
    "feature_min_max_array",
    "SELECT 'x' || CAST(pos AS VARCHAR) AS feature, COALESCE(min(CASE WHEN NOT isnan(v) THEN v END), CAST('Infinity' AS DOUBLE)) AS min_value, "
    "COALESCE(max(CASE WHEN NOT isnan(v) THEN v END), CAST('-Infinity' AS DOUBLE)) AS max_value FROM ("
    "SELECT generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY pos",
)
def q_feature_min_max_array(spark, sf):
    return stats.feature_min_max_array(read_table(spark, sf, "embeddings"), "embedding")


# ------------------------------------------------------------ D: grid


def _ord_spec_rows() -> list[tuple]:
    out, m = [], 1
    feats = list(ORD_SPLITS)
    mults = []
    for f in reversed(feats):
        mults.append(m)
        m *= ORD_SPLITS[f]
    mults = mults[::-1]
    return [(i, f, ORD_SPLITS[f], mults[i]) for i, f in enumerate(feats)]


@register(
    "grid_dimensions",
    cte(pts=points_sql("points_ord"), mm=_minmax_sql("pts", list(ORD_SPLITS)))
    + "\nSELECT CAST(s.level AS BIGINT) AS level, s.feature, mm.min_value AS lo, mm.max_value AS hi, "
    "CAST(s.splits AS BIGINT) AS splits, CAST(s.multiplier AS BIGINT) AS multiplier FROM (VALUES "
    + ", ".join(f"({lv}, '{f}', {s}, {m})" for lv, f, s, m in _ord_spec_rows())
    + ") s(level, feature, splits, multiplier) JOIN mm ON mm.feature = s.feature",
)
def q_grid_dimensions(spark, sf):
    """The grid spec as a table, bounds measured on the data."""
    mm = stats.feature_min_max(points(spark, sf, "points_ord"), list(ORD_SPLITS))
    spec = spark.createDataFrame(_ord_spec_rows(), "level bigint, feature string, splits bigint, multiplier bigint")
    return spec.join(F.broadcast(mm), "feature").select(
        "level", "feature", F.col("min_value").alias("lo"), F.col("max_value").alias("hi"), "splits", "multiplier"
    )


def _measured_sql() -> str:
    mm_cols = ", ".join(
        f"min(CASE WHEN NOT isnan({c}) THEN {c} END) AS lo{i}, max(CASE WHEN NOT isnan({c}) THEN {c} END) AS hi{i}"
        for i, c in enumerate(FEATS)
    )
    g = Grid.of(*[(c, 0.0, 1.0, s) for c, s in zip(FEATS, MEASURED_SPLITS)])
    terms = " + ".join(
        f"{axis_split_sql('p.' + a.column, a, CFG.policy, lo=f'mm.lo{i}', hi=f'mm.hi{i}')} * {m}"
        for i, (a, m) in enumerate(zip(g.axes, g.multipliers))
    )
    return cte(pts=PTS, mm=f"SELECT {mm_cols} FROM pts") + f"\nSELECT p.key, ({terms}) AS bin_no FROM pts p CROSS JOIN mm"


@register("grid_from_min_max", _measured_sql())
def q_grid_from_min_max(spark, sf):
    """A grid from measured bounds (8 numbers reach the driver)."""
    pts = points(spark, sf, CFG.view)
    rows = stats.feature_min_max(pts, FEATS).collect()
    g = stats.grid_from_min_max(rows, FEATS, MEASURED_SPLITS)
    return pts.select("key", bin_no(g, CFG.policy).alias("bin_no"))


@register(
    "axis_split",
    with_base() + "\nSELECT key, " + ", ".join(f"{axis_split_sql(a.column, a, CFG.policy)} AS s{i}" for i, a in enumerate(GRID.axes)) + " FROM pts",
)
def q_axis_split(spark, sf):
    pts = wb(spark, sf).points()
    return pts.select("key", *[axis_split(F.col(a.column), a, CFG.policy).alias(f"s{i}") for i, a in enumerate(GRID.axes)])


@register(
    "bin_coordinates",
    HIST.with_base() + "\nSELECT bin_no, " + ", ".join(f"{coordinate_sql('bin_no', GRID, i)} AS c{i}" for i in range(GRID.dims)) + " FROM counts",
)
def q_bin_coordinates(spark, sf):
    return with_cell_coordinates(whole(spark, sf).counts().select("bin_no"), GRID)


@register(
    "bin_ancestors",
    HIST.with_base()
    + "\n"
    + "\nUNION ALL\n".join(
        f"SELECT bin_no, CAST({lv} AS BIGINT) AS level, {ancestor_sql('bin_no', GRID, lv)} AS ancestor_id FROM counts"
        for lv in range(GRID.dims + 1)
    ),
)
def q_bin_ancestors(spark, sf):
    cells = whole(spark, sf).counts().select("bin_no")
    lv = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(GRID.dims).cast("bigint"))).alias("level")
    anc = F.lit(0).cast("bigint")
    for level in range(1, GRID.dims + 1):
        anc = F.when(F.col("level") == level, ancestor("bin_no", GRID, level)).otherwise(anc)
    return cells.select("bin_no", lv).select("bin_no", "level", anc.alias("ancestor_id"))


@register(
    "dense_histogram",
    HIST.with_base() + f"\nSELECT r.range AS bin_no, CAST(COALESCE(c.n, 0) AS BIGINT) AS n FROM range({GRID.cells}) r LEFT JOIN counts c ON c.bin_no = r.range",
)
def q_dense_histogram(spark, sf):
    return dense_histogram(spark, whole(spark, sf).counts(), GRID)


# ----------------------------------------------------- E: histogram


@register("bin_histogram", HIST.with_base() + "\nSELECT bin_no, n FROM counts")
def q_bin_histogram(spark, sf):
    return whole(spark, sf).counts()


def _tree_sql() -> str:
    d = GRID.dims
    coords = ", ".join(f"{coordinate_sql('bin_no', GRID, i)} AS c{i}" for i in range(d))
    cs = ", ".join(f"c{i}" for i in range(d))
    node = " + ".join(f"COALESCE(c{i}, 0) * {m}" for i, m in enumerate(GRID.multipliers))
    return HIST.with_base(
        cc=f"SELECT n, {coords} FROM counts",
        tree=f"SELECT CAST({d} - bit_count(grouping_id({cs})) AS BIGINT) AS level, CAST({node} AS BIGINT) AS node_id, "
        f"CAST(sum(n) AS BIGINT) AS subtotal FROM cc GROUP BY ROLLUP({cs})",
    )


@register("histogram_tree", _tree_sql() + "\nSELECT level, node_id, subtotal FROM tree")
def q_histogram_tree(spark, sf):
    return histogram_tree(whole(spark, sf).counts(), GRID)


@register(
    "tree_children",
    _tree_sql()
    + "\nSELECT level - 1 AS level, CASE "
    + " ".join(f"WHEN level = {lv} THEN {ancestor_sql('node_id', GRID, lv - 1)}" for lv in range(2, GRID.dims + 1))
    + " ELSE CAST(0 AS BIGINT) END AS node_id, node_id AS child_id, subtotal AS child_subtotal FROM tree WHERE level >= 1",
)
def q_tree_children(spark, sf):
    return tree_children(histogram_tree(whole(spark, sf).counts(), GRID), GRID)


@register(
    "level_targets",
    HIST.with_base(tg=targets_sql("counts", GRID, CFG.n_groups))
    + "\n"
    + "\nUNION ALL\n".join(f"SELECT CAST({lv} AS BIGINT) AS level, q{lv} AS target FROM tg" for lv in range(GRID.dims)),
)
def q_level_targets(spark, sf):
    tot = whole(spark, sf).counts().agg(F.sum("n").alias("total"))
    qs = level_target_cols(F.coalesce(F.col("total"), F.lit(0)), CFG.n_groups, GRID.dims)
    stack = tot.select(*[q.alias(f"q{i}") for i, q in enumerate(qs)])
    return stack.selectExpr(
        f"stack({GRID.dims}, " + ", ".join(f"CAST({i} AS BIGINT), q{i}" for i in range(GRID.dims)) + ") AS (level, target)"
    )


@register(
    "axis_cut",
    HIST.with_groups()
    + "\n"
    + "\nUNION ALL\n".join(
        f"SELECT CAST({lv} AS BIGINT) AS level, path, s, e, CAST(tot AS BIGINT) AS total FROM g_runs{lv}" for lv in range(GRID.dims)
    ),
)
def q_axis_cut(spark, sf):
    g = whole(spark, sf).grouping()
    out = None
    for lv in range(GRID.dims):
        r = g.runs(lv).select(F.lit(lv).cast("bigint").alias("level"), "path", "s", "e", F.col("tot").alias("total"))
        out = r if out is None else out.unionByName(r)
    return out


BOUNDS = [f for i in range(GRID.dims) for f in (f"lo{i}", f"hi{i}")]


@register("equi_depth_groups", HIST.with_groups() + f"\nSELECT group_id, group_key, {', '.join(BOUNDS)}, total FROM g_groups")
def q_equi_depth_groups(spark, sf):
    return whole(spark, sf).grouping().groups


def _members_sql() -> str:
    cols = ", ".join(BOUNDS)
    cur = f"SELECT group_id, CAST(0 AS BIGINT) AS bin_no, {cols} FROM g_groups"
    for i, m in enumerate(GRID.multipliers):
        rest = ", ".join(BOUNDS[2 * (i + 1):])
        rest = f", {rest}" if rest else ""
        cur = (
            f"SELECT group_id, bin_no + c * {m} AS bin_no{rest} FROM (SELECT group_id, bin_no, "
            f"CAST(unnest(generate_series(lo{i}, hi{i})) AS BIGINT) AS c{rest} FROM ({cur}))"
        )
    return cur


MEMBERS = f"SELECT m.group_id, m.bin_no, CAST(COALESCE(c.n, 0) AS BIGINT) AS n FROM ({_members_sql()}) m LEFT JOIN counts c ON c.bin_no = m.bin_no"


@register("group_members", HIST.with_groups(mem=MEMBERS) + "\nSELECT group_id, bin_no, n FROM mem")
def q_group_members(spark, sf):
    w = whole(spark, sf)
    return group_members(w.grouping(), w.counts())


@register("group_totals", HIST.with_groups() + "\nSELECT group_id, total FROM g_groups")
def q_group_totals(spark, sf):
    return whole(spark, sf).grouping().groups.select("group_id", "total")


@register("group_count", HIST.with_groups() + f"\nSELECT CAST({CFG.n_groups} AS BIGINT) AS n_wanted, count(*) AS n_groups FROM g_groups")
def q_group_count(spark, sf):
    return whole(spark, sf).grouping().groups.agg(
        F.lit(CFG.n_groups).cast("bigint").alias("n_wanted"), F.count(F.lit(1)).alias("n_groups")
    )


@register("assign_bin_group", HIST.with_groups() + "\nSELECT key, bin_no, group_id FROM routed")
def q_assign_bin_group(spark, sf):
    return whole(spark, sf).routed().select("key", "bin_no", "group_id")


# ---------------------------------------------------------- G: training


@register("train_global", with_base(**trained("wglob")) + f"\nSELECT model_id, n, {W_COLS} FROM wglob_final")
def q_train_global(spark, sf):
    m = wb(spark, sf).models_global()
    t = m.table(spark)
    return t.select("model_id", "n", *[r4(F.col(f"w{j}")).alias(f"w{j}") for j in range(len(FEATS))])


# the single model at the minimum of its loss (with a small ridge)
NEWTON_L2, NEWTON_STEPS = 1e-3, 15


@register(
    "train_global_converged",
    with_base(**newton_sql("SELECT * FROM pts WHERE fit", FEATS, NEWTON_STEPS, NEWTON_L2))
    + f"\nSELECT CAST(0 AS BIGINT) AS model_id, n, {W_COLS} FROM nw CROSS JOIN nw_n WHERE it = {NEWTON_STEPS}",
)
def q_train_global_converged(spark, sf):
    w = wb(spark, sf)
    return _weights(fit_newton(w.train(), FEATS, NEWTON_L2, partitions=CFG.partitions).models, spark, len(FEATS))


@register("train_per_group", with_groups(**trained("wgrp")) + f"\nSELECT model_id, n, {W_COLS} FROM wgrp_final")
def q_train_per_group(spark, sf):
    t = wb(spark, sf).models_group().table(spark)
    return t.select("model_id", "n", *[r4(F.col(f"w{j}")).alias(f"w{j}") for j in range(len(FEATS))])


@register("train_per_part", with_base(**trained("wpart")) + f"\nSELECT model_id, n, {W_COLS} FROM wpart_final")
def q_train_per_part(spark, sf):
    t = wb(spark, sf).models_part().table(spark)
    return t.select("model_id", "n", *[r4(F.col(f"w{j}")).alias(f"w{j}") for j in range(len(FEATS))])


@register(
    "apply_threshold",
    with_base(**trained("wglob"), sg=SCORED_GLOBAL) + "\nSELECT key, round(probability, 6) AS probability, prediction FROM sg",
)
def q_apply_threshold(spark, sf):
    return wb(spark, sf).scored_global().select("key", F.round("probability", 6).alias("probability"), "prediction")


# ----------------------------------------------------------- H: scoring


@register("predict_global", with_base(**trained("wglob"), sg=SCORED_GLOBAL) + "\nSELECT key, label, prediction FROM sg")
def q_predict_global(spark, sf):
    return wb(spark, sf).scored_global().select("key", "label", "prediction")


@register(
    "predict_routed", with_groups(**trained("wgrp"), sr=SCORED_ROUTED) + "\nSELECT key, group_id, label, prediction FROM sr"
)
def q_predict_routed(spark, sf):
    return wb(spark, sf).scored_routed().select("key", "group_id", "label", "prediction")


@register("predict_vote", with_base(**trained("wpart"), sv=SCORED_VOTE) + "\nSELECT key, label, ones, prediction FROM sv")
def q_predict_vote(spark, sf):
    return wb(spark, sf).scored_vote().select("key", "label", F.col("ones").cast("bigint").alias("ones"), "prediction")


@register(
    "score_label_pairs",
    with_groups(**trained("wgrp"), sr=SCORED_ROUTED) + "\nSELECT key, prediction AS score, label FROM sr",
)
def q_score_label_pairs(spark, sf):
    return wb(spark, sf).scored_routed().select("key", F.col("prediction").alias("score"), "label")


# -------------------------------------------------------- I: evaluation


@register("accuracy_pct", with_groups(**trained("wgrp"), sr=SCORED_ROUTED) + "\n" + acc_sql("sr"))
def q_accuracy_pct(spark, sf):
    return accuracy(wb(spark, sf).scored_routed())


@register("accuracy_by_group", with_groups(**trained("wgrp"), sr=SCORED_ROUTED) + "\n" + acc_sql("sr", "group_id"))
def q_accuracy_by_group(spark, sf):
    return accuracy(wb(spark, sf).scored_routed(), by=["group_id"])


@register("auc_class", with_groups(**trained("wgrp"), sr=SCORED_ROUTED) + "\n" + auc_sql("sr"))
def q_auc_class(spark, sf):
    return auc(wb(spark, sf).scored_routed())


@register("auc_score", with_base(**trained("wglob"), sg=SCORED_GLOBAL) + "\n" + auc_sql("sg", "probability"))
def q_auc_score(spark, sf):
    return auc(wb(spark, sf).scored_global(), score="probability")


def _report_sql(suite: Suite) -> str:
    parts = {}
    for kind in ("wglob", "wgrp", "wpart"):
        parts.update(suite.trained(kind))
    parts.update(sg=suite.scored_global, sr=suite.scored_routed, sv=suite.scored_vote)
    rows = []
    for name, src, m in (("single", "sg", "wglob_final"), ("histogram", "sr", "wgrp_final"), ("random", "sv", "wpart_final")):
        rows.append(
            f"SELECT '{name}' AS strategy, (SELECT count(*) FROM {m}) AS n_models, a.n, a.correct, a.accuracy_pct, u.auc "
            f"FROM ({acc_sql(src)}) a CROSS JOIN ({auc_sql(src)}) u"
        )
    return suite.with_groups(**parts) + "\n" + "\nUNION ALL\n".join(rows)


@register("strategy_report", _report_sql(MAIN))
def q_strategy_report(spark, sf):
    return wb(spark, sf).report()


# ------------------------------------------------------ J: quality checks


@register(
    "group_balance",
    HIST.with_groups(
        mean="SELECT CASE WHEN count(*) > 0 THEN CAST(CAST(sum(total) AS BIGINT) // count(*) AS DOUBLE) END AS mean FROM g_groups"
    )
    + "\nSELECT group_id, total, mean, mean * CAST('0.9' AS DOUBLE) AS lower, mean * CAST('1.1' AS DOUBLE) AS upper, "
    "(total > mean * CAST('0.9' AS DOUBLE) AND total < mean * CAST('1.1' AS DOUBLE)) AS balanced FROM g_groups CROSS JOIN mean",
)
def q_group_balance(spark, sf):
    return quality.group_balance(whole(spark, sf).grouping().groups)


def _adjacency_sql() -> str:
    nb = []
    for i, (s, m) in enumerate(zip(GRID.splits, GRID.multipliers)):
        c = coordinate_sql("bin_no", GRID, i)
        nb.append(f"SELECT group_id, bin_no, bin_no - {m} AS nb FROM mem WHERE {c} > 0")
        nb.append(f"SELECT group_id, bin_no, bin_no + {m} AS nb FROM mem WHERE {c} < {s - 1}")
    cand = "\nUNION ALL\n".join(nb)
    linked = (
        f"SELECT DISTINCT c.group_id, c.bin_no FROM ({cand}) c WHERE EXISTS "
        "(SELECT 1 FROM mem o WHERE o.group_id = c.group_id AND o.bin_no = c.nb)"
    )
    return HIST.with_groups(mem=MEMBERS, linked=linked) + (
        "\nSELECT m.group_id, count(*) AS n_cells, CAST(sum(CASE WHEN l.bin_no IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_isolated, "
        "sum(CASE WHEN l.bin_no IS NULL THEN 1 ELSE 0 END) = 0 AS adjacent "
        "FROM mem m LEFT JOIN linked l ON l.group_id = m.group_id AND l.bin_no = m.bin_no GROUP BY m.group_id"
    )


@register("group_adjacency", _adjacency_sql())
def q_group_adjacency(spark, sf):
    w = whole(spark, sf)
    return quality.group_adjacency(group_members(w.grouping()), GRID)


def _distance_sql() -> str:
    terms = " + ".join(
        f"({coordinate_sql('c.bin_no', GRID, i)} - {coordinate_sql('g.group_key', GRID, i)}) * ({coordinate_sql('c.bin_no', GRID, i)} - {coordinate_sql('g.group_key', GRID, i)})"
        for i in range(GRID.dims)
    )
    cells = route_sql("counts", GRID, compatible=False)
    return HIST.with_groups(cg=cells) + (
        f"\nSELECT c.bin_no, c.group_id, CAST({terms} AS BIGINT) AS dist2 FROM cg c JOIN g_groups g ON g.group_id = c.group_id"
    )


@register("bin_distance", _distance_sql())
def q_bin_distance(spark, sf):
    w = whole(spark, sf)
    cells = route(w.counts().select("bin_no"), w.grouping(), compatible=False).where(F.col("group_id").isNotNull())
    g = w.grouping().groups.select(F.col("group_id").alias("gid"), "group_key")
    j = cells.join(broadcast_if_small(g, w.grouping().n_groups), F.col("group_id") == F.col("gid"))
    return j.select(
        "bin_no",
        "group_id",
        quality.squared_distance(quality.coordinates_array(GRID, "bin_no"), quality.coordinates_array(GRID, "group_key")).alias(
            "dist2"
        ),
    )


# ------------------------------------- the same operators on other data shapes
# events: skewed values, so very uneven cells; embeddings: 64-wide features.

EV_CFG = Config(
    view="points_ev", features=("x0", "x1", "x2"), scaled=True, train_share=0.7, partitions=8,
    grid=Grid.of(("x0", 0.0, 1.0, 8), ("x1", 0.0, 1.0, 6), ("x2", 0.0, 1.0, 4)),
    n_groups=10,
    n_parts=8,
)
VEC_CFG = Config(
    view="points_vec", features=tuple(f"x{i}" for i in range(64)), scaled=True, train_share=0.7, partitions=8,
    grid=Grid.of(("x0", 0.0, 1.0, 4), ("x1", 0.0, 1.0, 4), ("x2", 0.0, 1.0, 4)),
    n_groups=8,
    n_parts=4,
)
EV_HIST_CFG = replace(EV_CFG, train_share=None)
# far more cells than rows, and many groups: most cells are empty
SPARSE_CFG = Config(
    view="points_ev", features=("x0", "x1", "x2"), scaled=True, partitions=8,
    grid=Grid.of(("x0", 0.0, 1.0, 96), ("x1", 0.0, 1.0, 64), ("x2", 0.0, 1.0, 24)),
    n_groups=60,
)
# groups of the training rows alone: held-out rows may lie in cells of no group
SPARSE_SPLIT_CFG = replace(SPARSE_CFG, train_share=0.7)
# rows with null and NaN features
DIRTY_CFG = Config(
    view="points_dirty", scaled=True, train_share=0.7, partitions=8, iter_ensemble=30,
    grid=Grid.of(("x0", 0.0, 1.0, 6), ("x3", 0.0, 1.0, 6)), n_groups=4, n_parts=5,
)
SPARSE = Suite(SPARSE_CFG)
SPARSE_SPLIT = Suite(SPARSE_SPLIT_CFG)
EV_HIST = Suite(EV_HIST_CFG)
DIRTY = Suite(DIRTY_CFG)
EV = Suite(EV_CFG)
VEC = Suite(VEC_CFG)
EV_BOUNDS = [f for i in range(EV_CFG.grid.dims) for f in (f"lo{i}", f"hi{i}")]


def _weights(models, spark, k):
    t = models.table(spark)
    return t.select("model_id", "n", *[r4(F.col(f"w{j}")).alias(f"w{j}") for j in range(k)])


@register("equi_depth_groups_events", EV_HIST.with_groups() + f"\nSELECT group_id, group_key, {', '.join(EV_BOUNDS)}, total FROM g_groups")
def q_equi_depth_groups_events(spark, sf):
    return workbench(spark, sf, EV_HIST_CFG).grouping().groups


@register("assign_bin_group_events", EV_HIST.with_groups() + "\nSELECT key, bin_no, group_id FROM routed")
def q_assign_bin_group_events(spark, sf):
    return workbench(spark, sf, EV_HIST_CFG).routed().select("key", "bin_no", "group_id")


@register("train_per_part_embeddings", VEC.with_base(**VEC.trained("wpart")) + f"\nSELECT model_id, n, {VEC.w_cols} FROM wpart_final")
def q_train_per_part_embeddings(spark, sf):
    return _weights(workbench(spark, sf, VEC_CFG).models_part(), spark, len(VEC_CFG.features))


@register(
    "predict_vote_embeddings",
    VEC.with_base(**VEC.trained("wpart"), sv=VEC.scored_vote) + "\nSELECT key, label, ones, prediction FROM sv",
)
def q_predict_vote_embeddings(spark, sf):
    scored = workbench(spark, sf, VEC_CFG).scored_vote()
    return scored.select("key", "label", F.col("ones").cast("bigint").alias("ones"), "prediction")


# very many small models: the vote is a matrix product
MANY_CFG = replace(CFG, n_parts=2000, iter_ensemble=5)
MANY = Suite(MANY_CFG)


@register("predict_vote_many", MANY.with_base(**MANY.trained("wpart"), sv=MANY.scored_vote) + "\nSELECT key, label, ones, prediction FROM sv")
def q_predict_vote_many(spark, sf):
    scored = workbench(spark, sf, MANY_CFG).scored_vote()
    return scored.select("key", "label", F.col("ones").cast("bigint").alias("ones"), "prediction")


@register("strategy_report_embeddings", _report_sql(VEC))
def q_strategy_report_embeddings(spark, sf):
    return workbench(spark, sf, VEC_CFG).report()


@register("predict_routed_embeddings", VEC.with_groups(**VEC.trained("wgrp"), sr=VEC.scored_routed) + "\nSELECT key, group_id, label, prediction FROM sr")
def q_predict_routed_embeddings(spark, sf):
    return workbench(spark, sf, VEC_CFG).scored_routed().select("key", "group_id", "label", "prediction")


@register("train_per_group_events", EV.with_groups(**EV.trained("wgrp")) + f"\nSELECT model_id, n, {EV.w_cols} FROM wgrp_final")
def q_train_per_group_events(spark, sf):
    return _weights(workbench(spark, sf, EV_CFG).models_group(), spark, len(EV_CFG.features))


# one model for every user: the weights are a table that a join updates
USER_STEPS = 10
_USERS = EV_HIST.with_base(
    users="SELECT p.*, CAST(r.x1 AS BIGINT) AS user_id FROM pts p JOIN raw r ON r.key = p.key",
    **train_sql("SELECT * FROM users", EV.feats, "user_id", USER_STEPS, name="wusr"),
)


@register(
    "train_per_user",
    _USERS + f"\nSELECT w.model_id, c.n, {EV.w_cols} FROM wusr w JOIN wusr_n c ON c.model_id = w.model_id WHERE w.it = {USER_STEPS}",
)
def q_train_per_user(spark, sf):
    raw = points(spark, sf, EV_CFG.view).withColumn("user_id", F.col("x1").cast("bigint"))
    rows = unit_scaled(raw, workbench(spark, sf, EV_HIST_CFG).bounds())
    t = fit_table(rows, list(EV_CFG.features), "user_id", USER_STEPS, every=5)
    return t.select("model_id", "n", *[r4(F.col(f"w{j}")).alias(f"w{j}") for j in range(len(EV_CFG.features))])


@register("predict_routed_events", EV.with_groups(**EV.trained("wgrp"), sr=EV.scored_routed) + "\nSELECT key, group_id, label, prediction FROM sr")
def q_predict_routed_events(spark, sf):
    return workbench(spark, sf, EV_CFG).scored_routed().select("key", "group_id", "label", "prediction")


SPARSE_BOUNDS = [f for i in range(SPARSE_CFG.grid.dims) for f in (f"lo{i}", f"hi{i}")]


@register("equi_depth_groups_sparse", SPARSE.with_groups() + f"\nSELECT group_id, group_key, {', '.join(SPARSE_BOUNDS)}, total FROM g_groups")
def q_equi_depth_groups_sparse(spark, sf):
    return workbench(spark, sf, SPARSE_CFG).grouping().groups


# one axis of a million splits: cut in parallel, by prefix sums
LONG_CFG = replace(HIST_CFG, grid=Grid.of(("x1", 0.0, 1.0, 1_000_000)), n_groups=50)
LONG = Suite(LONG_CFG)
_OVER = "FILTER (WHERE o.cum - w.b > g.q0)"
_LONG_RUNS = {
    "tg": targets_sql("counts", LONG_CFG.grid, LONG_CFG.n_groups),
    "occ": "SELECT bin_no AS c, n AS w, CAST(sum(n) OVER (ORDER BY bin_no) AS BIGINT) AS cum FROM counts",
    "walk": (
        "SELECT CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi, CAST(NULL AS BIGINT) AS total\n"
        "UNION ALL\n"
        "SELECT CASE WHEN c1 IS NULL THEN NULL ELSE e + 1 END, b + tot, s, e, tot FROM (SELECT *, "
        "CASE WHEN c1 IS NULL THEN CAST(999999 AS BIGINT) WHEN short THEN c1 - 1 ELSE c1 END AS e, "
        "CASE WHEN c1 IS NULL THEN most - b WHEN short THEN cum1 - w1 - b ELSE cum1 - b END AS tot FROM (SELECT *, "
        "c1 > s AND q - (cum1 - w1 - b) < (cum1 - b) - q AS short FROM (SELECT w.s, w.b, any_value(g.q0) AS q, max(o.cum) AS most, "
        f"min(o.c) {_OVER} AS c1, min(o.cum) {_OVER} AS cum1, arg_min(o.w, o.c) {_OVER} AS w1 "
        "FROM walk w JOIN occ o ON o.c >= w.s CROSS JOIN tg g GROUP BY w.s, w.b)))"
    ),
}


@register(
    "equi_depth_groups_long",
    LONG.with_base(**_LONG_RUNS)
    + "\nSELECT CAST(row_number() OVER (ORDER BY lo) - 1 AS BIGINT) AS group_id, lo AS group_key, lo AS lo0, hi AS hi0, total FROM walk WHERE lo IS NOT NULL",
)
def q_equi_depth_groups_long(spark, sf):
    return workbench(spark, sf, LONG_CFG).grouping().groups


@register("assign_bin_group_sparse", SPARSE.with_groups() + "\nSELECT key, bin_no, group_id FROM routed")
def q_assign_bin_group_sparse(spark, sf):
    return workbench(spark, sf, SPARSE_CFG).routed().select("key", "bin_no", "group_id")


@register(
    "unassigned_rows_sparse",
    SPARSE_SPLIT.with_groups(strict=route_sql("bins", SPARSE_CFG.grid, compatible=False))
    + "\nSELECT count(*) AS n, count(*) FILTER (WHERE group_id IS NULL) AS n_unassigned FROM strict",
)
def q_unassigned_rows_sparse(spark, sf):
    """Rows in cells of no group, which compatible routing sends to group 0."""
    w = workbench(spark, sf, SPARSE_SPLIT_CFG)
    strict = route(w.binned(), w.grouping(), compatible=False)
    return strict.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("group_id").isNull(), 1)).alias("n_unassigned"))


@register("train_global_dirty", DIRTY.with_base(**DIRTY.trained("wglob")) + f"\nSELECT model_id, n, {DIRTY.w_cols} FROM wglob_final")
def q_train_global_dirty(spark, sf):
    return _weights(workbench(spark, sf, DIRTY_CFG).models_global(), spark, len(DIRTY_CFG.features))


@register(
    "predict_global_dirty",
    DIRTY.with_base(**DIRTY.trained("wglob"), sg=DIRTY.scored_global) + "\nSELECT key, round(probability, 6) AS probability, prediction FROM sg",
)
def q_predict_global_dirty(spark, sf):
    return workbench(spark, sf, DIRTY_CFG).scored_global().select("key", F.round("probability", 6).alias("probability"), "prediction")


@register("predict_vote_dirty", DIRTY.with_base(**DIRTY.trained("wpart"), sv=DIRTY.scored_vote) + "\nSELECT key, label, ones, prediction FROM sv")
def q_predict_vote_dirty(spark, sf):
    scored = workbench(spark, sf, DIRTY_CFG).scored_vote()
    return scored.select("key", "label", F.col("ones").cast("bigint").alias("ones"), "prediction")


@register("strategy_report_dirty", _report_sql(DIRTY))
def q_strategy_report_dirty(spark, sf):
    return workbench(spark, sf, DIRTY_CFG).report()


# the other split policies, over bounds that many rows lie outside of
OUT_GRID = Grid.of(("x0", 5.0, 45.0, 8), ("x1", 5000.0, 60000.0, 7))


def _policy_sql(policy: str) -> str:
    splits = ", ".join(f"{axis_split_sql(a.column, a, policy)} AS s{i}" for i, a in enumerate(OUT_GRID.axes))
    return cte(pts=PTS) + f"\nSELECT key, {splits}, {bin_no_sql(OUT_GRID, policy)} AS bin_no FROM pts"


def _policy_rows(spark, sf, policy: str) -> DataFrame:
    splits = [axis_split(F.col(a.column), a, policy).alias(f"s{i}") for i, a in enumerate(OUT_GRID.axes)]
    return points(spark, sf, CFG.view).select("key", *splits, bin_no(OUT_GRID, policy).alias("bin_no"))


@register("axis_split_raw", _policy_sql("raw"))
def q_axis_split_raw(spark, sf):
    return _policy_rows(spark, sf, "raw")


@register("axis_split_null", _policy_sql("null"))
def q_axis_split_null(spark, sf):
    return _policy_rows(spark, sf, "null")
