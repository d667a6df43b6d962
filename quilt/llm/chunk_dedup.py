"""Exact dedup by content-defined chunk recipes, with DataFrame operations only.

The normalised text (A-Z lower-cased) is cut where its content says so: after
every line end, and inside long lines after the first blank beyond 192
characters (or after 1,024 without one). Chunks are deduplicated to verified
identifiers: a chunk's identifier is its 64-bit hash, the distinct chunks are
grouped by hash, and where a hash has several contents each content gets an
identifier of its own. A document is then its recipe, the ordered list of its
identifiers: two texts are equal exactly when their recipes are. Texts cross
the network once, as distinct chunks; from then on only recipes move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import join_ids, save

LONG_LINE = 1024
CUT = r"(?s).{192,1023}?\s|.{1,1024}"


def normalise(text: Column) -> Column:
    """Null is empty; A-Z is lower-cased, nothing else (``lower`` does just that
    to ASCII texts, and faster)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; together they are the text and a final
    line end."""
    def cut(line: Column) -> Column:
        whole = F.concat(line, F.lit("\n"))
        return F.when(F.length(line) < LONG_LINE, F.array(whole)).otherwise(
            F.regexp_extract_all(whole, F.lit(CUT), F.lit(0))
        )

    return F.flatten(F.transform(F.split(text, "\n", -1), cut))


def _clashing_hashes(parts: DataFrame) -> DataFrame:
    """Hashes that several distinct chunks have. ``parts``: _h, _chunk."""
    return save(
        parts.distinct().groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    )


def recipes(rows: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``_row``, ``_id``, ``_sha`` and the verified ``_recipe`` of each text
    (``_text``). ``chunk_hash`` gives 64 bits; tests pass a weak one."""
    texts = rows.withColumn("_norm", normalise(F.col("_text"))).select(
        "_row", "_id", F.sha2(F.encode("_norm", "UTF-8"), 256).alias("_sha"),
        chunks(F.col("_norm")).alias("_chunks"),
    )
    parts = texts.select(F.explode("_chunks").alias("_chunk"))
    parts = parts.withColumn("_h", chunk_hash(F.col("_chunk")))
    clashing = _clashing_hashes(parts)
    n = clashing.count()
    if not n:
        return save(texts.select("_row", "_id", "_sha", F.transform("_chunks", lambda c: chunk_hash(c)).alias("_recipe")))
    # an identifier per content for the clashing hashes, and recipes with them;
    # told and untold identifiers are kept apart by a flag
    contents = join_ids(parts, clashing, ["_h"], n).distinct()
    ids = save(contents.withColumn("_number", F.monotonically_increasing_id()))
    told = (
        texts.select("_row", "_id", "_sha", F.posexplode("_chunks").alias("_pos", "_chunk"))
        .withColumn("_h", chunk_hash(F.col("_chunk")))
        .join(ids, ["_h", "_chunk"], "left")
        .withColumn("_part", F.struct(
            "_pos", F.coalesce("_number", "_h").alias("id"),
            F.col("_number").isNotNull().cast("bigint").alias("told"),
        ))
    )
    parts_of = F.sort_array(F.collect_list("_part"))
    return save(
        told.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("_sha").alias("_sha"), parts_of.alias("_parts"))
        .select("_row", "_id", "_sha", F.flatten(F.transform("_parts", lambda p: F.array(p["id"], p["told"]))).alias("_recipe"))
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id`` (the largest id of the
    equal texts), ``group_size``, ``kept`` and ``text_sha256`` of the normalised
    text; with ``row_col`` also that column of ``docs``, a unique row number.

    * null texts count as empty, and all empty texts are equal;
    * exactly one row of each group is kept: of several that repeat the largest
      id, any one; a group whose ids are all null keeps one row, with a null
      ``keep_id``;
    * long texts are cut into as many chunks as they hold, and only chunks move;
    * an empty table gives an empty result; other columns are not read.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(row.alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    told = recipes(rows, chunk_hash)
    groups = save(
        told.groupBy("_recipe").agg(
            F.count(F.lit(1)).alias("_size"), F.max("_id").alias("_keep"),
            F.coalesce(F.max_by("_row", "_id"), F.max("_row")).alias("_keep_row"),
        ).where("_size > 1")
    )
    out = told.join(groups, "_recipe", "left")
    alone = F.col("_size").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_keep_row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.col("_row").alias(row_col)] if row_col else []),
    )
