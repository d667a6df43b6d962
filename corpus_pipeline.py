"""The training-data pipeline: raw ``documents`` to packed sequences.

Each stage is (name, function of (spark, docs, sf_dir)); its rows are written as
Parquet and read again as the next stage's documents. All stages but the last
return the columns of ``documents``. Decisions hold for whole rows, told apart by
id and text; every stage takes an empty table to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.llm import toxicity
from quilt.llm.chunk_dedup import exact_dedup, normalise
from quilt.llm.common import join_ids, read_table, save, shared_folder
from quilt.llm.mixing import sample_mix
from quilt.llm.ngram_join import Jaccard, jaccard_components
from quilt.llm.packing import pack
from quilt.llm.tokens import public_path

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as not toxic."""
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels, toxicity.fold() != 0))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id. Rows are told apart by id and
    text; of rows that repeat both, one stays."""
    key = F.struct(F.col("doc_id").alias("i"), F.unhex("text_sha256").alias("s"))
    told = exact_dedup(docs).select("kept", key.alias("_key"))
    gone = save(told.where("not kept").select("_key").distinct())
    again = save(told.where("kept").select("_key").join(gone, "_key").distinct())
    sha = F.unhex(F.sha2(F.encode(normalise(F.col("text")), "UTF-8"), 256))
    rows = docs.withColumn("_key", F.struct(F.col("doc_id").alias("i"), sha.alias("s")))
    out = join_ids(rows, gone, ["_key"], gone.count(), "left_anti").select(docs.columns)
    n = again.count()
    if n:
        one = join_ids(rows, again, ["_key"], n).dropDuplicates(["_key"])
        out = out.unionByName(one.select(docs.columns))
    return out


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (word shingles of five, similarity 0.8)
    the row with the smallest id. Rows are told apart by id and text, as in
    ``drop_exact``; a row without an id stays only where no other does."""
    sha = F.unhex(F.sha2(F.encode(normalise(F.col("text")), "UTF-8"), 256))
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), sha.alias("s"))
    rows = docs.withColumn("_key", key)
    groups = jaccard_components(rows, Jaccard(width=5, num=80, den=100), id_col="_key")
    gone = save(groups.where("_key != component_id").select("_key").distinct())
    return join_ids(rows, gone, ["_key"], gone.count(), "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the target shares of source, language and topic."""
    return sample_mix(docs, tokenizer=public_path(TOKENIZER))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, none across documents."""
    return pack(docs, public_path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("n-gram Jaccard join", drop_near),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

# Scores and learnt models are not expressible in SQL; the stages are tested
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
