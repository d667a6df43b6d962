"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.llm import language_id, toxicity
from quilt.llm.chunk_dedup import exact_dedup
from quilt.llm.common import read_table, utf8
from quilt.llm.fuzzy_lines import fuzzy_lines
from quilt.llm.hard_negatives import hard_negatives
from quilt.llm.hilbert import hilbert_shards
from quilt.llm.mixing import mix_to_targets
from quilt.llm.ngram_join import Jaccard, jaccard_components
from quilt.llm.packing import pack
from quilt.llm.pii import find_pii
from quilt.llm.permutation_index import permutation_search
from quilt.llm.token_alignment import align_tokens
from quilt.llm.token_store import read_documents, write_store
from quilt.llm.tokens import public_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_ngram_jaccard")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), Jaccard(width=3, num=90, den=100))


@query("op2_token_store")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    store = write_store(docs, public_path("byte_bpe_50k.json"))
    return read_documents(spark, store, docs)


@query("op3_pii_disclosure")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"), with_text=True)


@query("op4_hilbert_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = utf8(F.col("text"))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    docs = docs.withColumn("magnitude", F.floor(F.log2("size") * 4))
    out = hilbert_shards(
        docs, ["source", "lang", "magnitude"], 40, "doc_id", ties=["text_crc32"], carry=["size", "text_crc32"]
    )
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "cell",
    )


@query("op5_permutation_index")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op6_fuzzy_lines")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(read_table(spark, sf_dir, "documents"), near="edit")


@query("op7_raking_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(read_table(spark, sf_dir, "documents"), tokenizer=public_path("word_bpe_49k.json"))


@query("op8_binary_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


@query("op9_chunk_recipes", """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


@query("op10_toxicity_channel")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, toxicity.fold() != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", "predicted")


@query("op11_hard_negatives", """
WITH t AS (
  SELECT CAST(vec_id AS BIGINT) AS id,
         CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM t a JOIN t b ON a.id <> b.id WHERE a.id % 100 = 0),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k
  FROM s WHERE same),
neg AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, n.id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS k
  FROM pos p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
  WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM neg WHERE k <= 5
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return align_tokens(docs, public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    trees = language_id.fit(docs, toxicity.fold() != 0)
    held_out = (toxicity.fold() == 0).alias("held_out")
    return language_id.predict(docs, trees, [held_out]).select("doc_id", "held_out", "lang_pred", "score")
