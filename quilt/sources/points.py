"""Labeled-point views over the given tables.

Every view has the columns ``(key string, label double, x0..xk double)``: a
unique row key (used for stable hashing), a 0/1 label and dense features. Each
view is defined twice from one place, as a DataFrame and as DuckDB SQL, so the
oracle reads exactly the same points. Features get ``+ 0.0`` so that -0.0 in
the source becomes 0.0 on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def _points(key: Column, label: Column, xs: list[Column]) -> list[Column]:
    return [key.alias("key"), label.cast("double").alias("label")] + [
        (x.cast("double") + F.lit(0.0)).alias(f"x{i}") for i, x in enumerate(xs)
    ]


def _sql(key: str, label: str, xs: list[str], source: str) -> str:
    cols = ",\n  ".join(f"CAST({x} AS DOUBLE) + CAST(0.0 AS DOUBLE) AS x{i}" for i, x in enumerate(xs))
    return f"SELECT {key} AS key, CAST({label} AS DOUBLE) AS label,\n  {cols}\nFROM {source}"


# ------------------------------------------------------------------ views


def _lineitem_points(li: DataFrame, lab: Column, price: Column, discount: Column) -> DataFrame:
    key = F.concat_ws(
        "|",
        _s(F.col("l_orderkey")),
        _s(F.col("l_partkey")),
        _s(F.col("l_suppkey")),
        _s(F.col("l_linenumber")),
        _s(F.round(F.col("l_quantity") * 100).cast("bigint")),
        _s(F.round(F.col("l_extendedprice") * 100).cast("bigint")),
        _s(F.col("l_shipdate").cast("date")),
    )
    return li.select(*_points(key, lab, [F.col("l_quantity"), price, discount, F.col("l_tax")]))


LINEITEM_KEY_SQL = (
    "concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), "
    "CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
    "CAST(CAST(round(l_quantity * 100) AS BIGINT) AS VARCHAR), "
    "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), "
    "CAST(CAST(l_shipdate AS DATE) AS VARCHAR))"
)


def _lineitem(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    lab = (
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
        if label == "returnflag"
        else F.when(F.col("l_extendedprice") > 50000.0, 1.0).otherwise(0.0)
    )
    li = read_table(spark, sf_dir, "lineitem")
    return _lineitem_points(li, lab, F.col("l_extendedprice"), F.col("l_discount"))


def _lineitem_sql(label: str) -> str:
    lab = (
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"
        if label == "returnflag"
        else "CASE WHEN l_extendedprice > CAST('50000.0' AS DOUBLE) THEN 1 ELSE 0 END"
    )
    return _sql(LINEITEM_KEY_SQL, lab, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem")


def _orders(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        *_points(
            _s(F.col("o_orderkey")),
            F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0),
            [F.col("o_totalprice"), F.dayofyear("o_orderdate")],
        )
    )


def _orders_sql(label: str) -> str:
    return _sql(
        "CAST(o_orderkey AS VARCHAR)",
        "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
        ["o_totalprice", "dayofyear(o_orderdate)"],
        "orders",
    )


def _events(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        *_points(
            _s(F.col("event_id")),
            F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0),
            [F.col("value"), F.col("user_id"), F.hour("ts")],
        )
    )


def _events_sql(label: str) -> str:
    return _sql(
        "CAST(event_id AS VARCHAR)",
        "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END",
        ["value", "user_id", "hour(ts)"],
        "events",
    )


EMBED_DIM = 64


def _embeddings(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    v = read_table(spark, sf_dir, "embeddings")
    # another width fails the job (a null vector has null features)
    wrong = F.raise_error(F.concat(F.lit("embedding width: "), F.size("embedding").cast("string")))
    first = F.when(F.size("embedding") != EMBED_DIM, wrong).otherwise(F.get(F.col("embedding"), 0))
    first = F.when(F.col("embedding").isNotNull(), first)
    xs = [first] + [F.get(F.col("embedding"), i) for i in range(1, EMBED_DIM)]
    return v.select(*_points(_s(F.col("vec_id")), F.when(F.col("label") >= 5, 1.0).otherwise(0.0), xs))


def vector_points(spark: SparkSession, sf_dir: str, view: str, label: str | None = None) -> DataFrame:
    """A view's points with all features in one array column: ``(key, label, x)``.
    A plan over it stays as small as over one feature."""
    if view != "points_vec":
        df = points(spark, sf_dir, view, label)
        return df.select("key", "label", F.array(*features(df)).alias("x"))
    v = read_table(spark, sf_dir, "embeddings")
    wrong = F.raise_error(F.concat(F.lit("embedding width: "), F.size("embedding").cast("string")))
    none = F.array_repeat(F.lit(None).cast("double"), EMBED_DIM)
    x = F.when(F.col("embedding").isNull(), none).when(F.size("embedding") != EMBED_DIM, wrong).otherwise(
        F.transform("embedding", lambda e: e.cast("double") + F.lit(0.0))
    )
    lab = F.when(F.col("label") >= 5, 1.0).otherwise(0.0)
    return v.select(_s(F.col("vec_id")).alias("key"), lab.alias("label"), x.alias("x"))


def _embeddings_sql(label: str) -> str:
    return _sql(
        "CAST(vec_id AS VARCHAR)",
        "CASE WHEN label >= 5 THEN 1 ELSE 0 END",
        [f"embedding[{i + 1}]" for i in range(EMBED_DIM)],
        "embeddings",
    )


def _documents(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    words = F.size(F.filter(F.split(F.col("text"), " "), lambda w: w != ""))
    lines = F.size(F.split(F.col("text"), "\n"))
    return d.join(lab, "doc_id").select(
        *_points(
            _s(F.col("doc_id")),
            F.when(F.col("quality") == 1, 1.0).otherwise(0.0),
            [F.col("n_chars"), words, lines],
        )
    )


def _documents_sql(label: str) -> str:
    return _sql(
        "CAST(d.doc_id AS VARCHAR)",
        "CASE WHEN l.quality = 1 THEN 1 ELSE 0 END",
        [
            "d.n_chars",
            "len(list_filter(string_split(d.text, ' '), lambda w: w <> ''))",
            "len(string_split(d.text, chr(10)))",
        ],
        "documents d JOIN labels l ON d.doc_id = l.doc_id",
    )


def _dirty(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Lineitem points of which some lack a feature and some hold NaN."""
    price = F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice"))
    discount = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    lab = F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)
    return _lineitem_points(read_table(spark, sf_dir, "lineitem"), lab, price, discount)


def _dirty_sql(label: str) -> str:
    return _sql(
        LINEITEM_KEY_SQL,
        "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END",
        [
            "l_quantity",
            "CASE WHEN l_linenumber <> 2 THEN l_extendedprice END",
            "CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) ELSE l_discount END",
            "l_tax",
        ],
        "lineitem",
    )


@dataclass(frozen=True)
class View:
    name: str
    width: int
    build: Callable[[SparkSession, str, str], DataFrame]
    sql: Callable[[str], str]
    default_label: str = "default"
    tables: tuple[str, ...] = ("lineitem",)


VIEWS: dict[str, View] = {
    "points_li": View("points_li", 4, _lineitem, _lineitem_sql, "returnflag"),
    "points_ord": View("points_ord", 2, _orders, _orders_sql, tables=("orders",)),
    "points_ev": View("points_ev", 3, _events, _events_sql, tables=("events",)),
    "points_vec": View("points_vec", EMBED_DIM, _embeddings, _embeddings_sql, tables=("embeddings",)),
    "points_doc": View("points_doc", 3, _documents, _documents_sql, tables=("documents", "labels")),
    "points_dirty": View("points_dirty", 4, _dirty, _dirty_sql),
}


def points(spark: SparkSession, sf_dir: str, view: str = "points_li", label: str | None = None) -> DataFrame:
    v = VIEWS[view]
    return v.build(spark, sf_dir, label or v.default_label)


def unit_scaled(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Features moved to [0, 1] by measured bounds; a constant feature is 0."""
    return df.select(*[
        F.when(F.lit(bounds[c][1] > bounds[c][0]), (F.col(c) - F.lit(bounds[c][0])) / F.lit(bounds[c][1] - bounds[c][0]))
        .otherwise(F.lit(0.0)).alias(c) if c in bounds else F.col(c)
        for c in df.columns
    ])


def unit_scaled_array(df: DataFrame, bounds: list[tuple[float, float]], column: str = "x") -> DataFrame:
    """The same for features in one array column, in the order of ``bounds``."""
    lo, size = (F.array(*[F.lit(float(v)) for v in vs]) for vs in ([a for a, _ in bounds], [b - a for a, b in bounds]))
    moved = F.transform(
        column, lambda v, i: F.when(F.get(size, i) > 0, (v - F.get(lo, i)) / F.get(size, i)).otherwise(F.lit(0.0))
    )
    return df.withColumn(column, moved)


def unit_scaled_sql(rows: str, bounds: str, columns: list[str]) -> str:
    """The same over CTEs ``rows`` and ``bounds`` (one row: lo_x0, hi_x0, ..)."""
    cols = ", ".join(
        f"CASE WHEN b.hi_{c} > b.lo_{c} THEN (p.{c} - b.lo_{c}) / (b.hi_{c} - b.lo_{c}) ELSE CAST('0.0' AS DOUBLE) END AS {c}"
        for c in columns
    )
    return f"SELECT p.key, p.label, {cols} FROM {rows} p CROSS JOIN {bounds} b"


def source_state(spark: SparkSession, sf_dir: str, view: str) -> tuple:
    """Files of a view's tables with size and time of change: what results that
    are kept between queries depend on."""
    state = []
    for t in VIEWS[view].tables:
        m = read_table(spark, sf_dir, t).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        state += sorted(tuple(map(str, r)) for r in m.distinct().collect())
    return tuple(state)


def points_sql(view: str = "points_li", label: str | None = None) -> str:
    v = VIEWS[view]
    return v.sql(label or v.default_label)


def features(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[:1] == "x" and c[1:].isdigit()), key=lambda c: int(c[1:]))
