"""Packing by power-of-two decomposition.

A document of n ids is cut into whole sequences of the longest length and the
powers of two of what is left, longest first. Each piece is a sequence by
itself, so no sequence crosses documents and none is padded; sequences of equal
length form a bucket, and batches are drawn from one bucket at a time. Every
document is encoded and cut in one narrow pass. Only the pieces, a few numbers
each, are put in order to number the sequences bucket by bucket.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import map_batches, running_offsets, save
from quilt.llm.tokens import encoder

PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids: ``longest`` as often as it fits, then the
    powers of two of the rest, falling."""
    out = [longest] * (n // longest)
    rest = n % longest
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def binary_pieces(
    docs: DataFrame, tokenizer: str, longest: int = 4096, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """The pieces of every row of ``docs``: id, ``start`` (ids of the document
    before the piece), ``length``, ``ids_crc32`` (of the ids as little-endian
    unsigned 32-bit integers), ``doc_tokens``, and with ``with_ids`` the ``ids``
    as binary. A null or empty text has the end id alone; long texts are encoded
    whole and cut into as many pieces as they need; rows that repeat an id are
    separate documents; an empty table gives an empty result; other columns are
    not read, whatever their names."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    end = end_id.to_bytes(4, "little")

    def cut(batch):
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        at, rows, payload = [], [], []
        for i, ids in enumerate(encoder(tokenizer).encode(texts)):
            ids += end
            n, start = len(ids) // 4, 0
            for length in binary_lengths(n, longest):
                piece = ids[start * 4 : (start + length) * 4]
                at.append(i)
                rows.append((start, length, zlib.crc32(piece), n))
                if with_ids:
                    payload.append(piece)
                start += length
        out = {"_id": batch.column("_id").take(pa.array(at))}
        for k, name in enumerate(("start", "length", "ids_crc32", "doc_tokens")):
            out[name] = pa.array([r[k] for r in rows], pa.int64())
        return out | ({"ids": pa.array(payload, pa.binary())} if with_ids else {})

    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    return map_batches(base, cut, f"_id {kind}, {PIECES}{', ids binary' if with_ids else ''}")


def pack(
    docs: DataFrame, tokenizer: str, longest: int = 4096, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """``binary_pieces`` with ``sequence_id`` (from 0 without gaps, bucket by
    bucket from the longest length, by id and start within) and ``offset`` in
    the sequence, 0 as each piece is a sequence. Cases as there."""
    # saved first: finding the ranges reads the rows, and must not encode again
    pieces = save(binary_pieces(docs, tokenizer, longest, end_id, id_col, text_col, with_ids))
    order = [F.desc("length"), F.asc("_id"), F.asc("start"), F.asc("ids_crc32")]
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    numbered = save(
        pieces.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = running_offsets(sizes, "_part", "_rows", "_before").select("_part", "_before")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .select(
            F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
            (F.col("_before") + within).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
            *(["ids"] if with_ids else []),
        )
    )
