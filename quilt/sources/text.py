"""Delimited text lines (A1-A3).

Lines are ``label,x1,x2,...`` with every field numeric. A marker filter drops
every line containing the marker (a header, and any data line that happens to
contain it). Parsing splits on ',' after dropping trailing commas (trailing
empty fields vanish, as in a Java split); fields are trimmed and cast to
double. ``strict`` fails the job on a bad field, like the reference's
``parseDouble``, and on a line with too few or too many fields; ``permissive``
yields nulls and flags such lines as ``bad`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quilt.session import broadcast_if_small, cut_lineage


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A1: text file(s) -> ``line``."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def drop_marker_lines(lines: DataFrame, marker: str | None, col: str = "line") -> DataFrame:
    """A2: drop every line containing ``marker`` (case-sensitive); None keeps all."""
    if marker is None:
        return lines
    return lines.where(~F.col(col).contains(marker))


def _field(parts: Column, i: int, strict: bool) -> Column:
    raw = F.get(parts, i)
    val = F.trim(raw).try_cast("double")
    if not strict:
        return val
    return F.when(raw.isNotNull() & val.isNull(), F.raise_error(F.concat(F.lit("bad numeric field: "), raw))).otherwise(
        val
    )


def parse_points(lines: DataFrame, width: int, col: str = "line", mode: str = "strict",
                 keep: list[str] | None = None) -> DataFrame:
    """A3: ``label, x0..x{width-1}`` from delimited lines. In strict mode a line
    without exactly ``width + 1`` fields fails; in permissive mode its missing
    fields are null and it is ``bad``."""
    if mode not in ("strict", "permissive"):
        raise ValueError(f"unknown mode {mode!r}")
    strict = mode == "strict"
    parts = F.split(F.regexp_replace(F.col(col), ",+$", ""), ",", -1)
    keep = keep or []
    fits = F.size("__p") == width + 1
    label = _field(F.col("__p"), 0, strict)
    if strict:
        # (the check rides on the label, which every reader of points needs)
        wrong = F.concat(F.lit(f"a line of {width + 1} fields expected, got "), F.size("__p").cast("string"))
        label = F.when(~fits, F.raise_error(wrong)).otherwise(label)
    out = lines.select(*keep, parts.alias("__p")).select(
        *keep,
        label.alias("label"),
        *[_field(F.col("__p"), i + 1, strict).alias(f"x{i}") for i in range(width)],
        *([] if strict else [fits.alias("__fits")]),
    )
    if not strict:
        cols = ["label"] + [f"x{i}" for i in range(width)]
        missing = F.exists(F.array(*[F.col(c) for c in cols]), lambda v: v.isNull())
        out = out.withColumn("bad", F.coalesce(~F.col("__fits"), F.lit(True)) | missing).drop("__fits")
    return out


def render_lines(points: DataFrame, width: int, keep: list[str] | None = None) -> DataFrame:
    """Points back to ``label,x0,...`` text (the reference's input format)."""
    keep = keep or []
    fields = [F.col("label").cast("string")] + [F.col(f"x{i}").cast("string") for i in range(width)]
    return points.select(*keep, F.concat_ws(",", *fields).alias("line"))


def document_lines(docs: DataFrame) -> DataFrame:
    """Whole documents split on newlines: ``(doc_id, line_no, line)``."""
    return docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line_no", "line")).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line"
    )


def write_lines(lines: DataFrame, path: str, file_col: str, order: list[str], col: str = "line") -> None:
    """Lines as text files under ``path``, one for each value of ``file_col``
    (folder ``file_col=value``), in the order given."""
    rows = lines.repartition(file_col).sortWithinPartitions(file_col, *order)
    rows.select(file_col, F.col(col).alias("value")).write.option("lineSep", "\n").partitionBy(file_col).text(path)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """A1 with a place for every line: ``(file, line_no, line, bad_encoding)`` and
    the partition columns of the path. ``line_no`` counts from 0 in each file,
    whatever splits it was read in: a split numbers its own lines, and a table
    with one row per split shifts them. Only a newline ends a line. Bytes that are
    no UTF-8 become the replacement sign, and such a line is ``bad_encoding``."""
    read = spark.read.option("lineSep", "\n").text(path)
    own = [c for c in read.columns if c != "value"]
    place = F.struct("_metadata.file_path", "_metadata.file_block_start").alias("__split")
    # (numbers depend on the files and their splits alone, so both reads agree)
    rows = read.select(*own, place, F.monotonically_increasing_id().alias("__id"), "value")
    splits = rows.groupBy("__split").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy("__split.file_path").orderBy("__split.file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    shift = cut_lineage(splits.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).drop("__n", "__first"))
    # a row per split: the path and two numbers
    joined = rows.join(broadcast_if_small(shift, shift.count(), 40), "__split")
    return joined.select(
        *own, F.col("__split.file_path").alias("file"), (F.col("__id") + F.col("__shift")).cast("bigint").alias("line_no"),
        F.make_valid_utf8("value").alias("line"), (~F.is_valid_utf8("value")).alias("bad_encoding"),
    )
