"""Random partitioning (F1-F3) and sampling (A4).

Part numbers and the hash sample come from the row key (see
``functions.hashing``): a retried task or a lost cache block gives the same
parts again, unlike an unseeded ``random()`` drawn per evaluation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.functions.hashing import stable_part, stable_uniform


def assign_random_part(points: DataFrame, n_parts: int, seed: int = 11, key: str = "key") -> DataFrame:
    """``part_id`` in 0..n_parts-1 for every row."""
    return points.withColumn("part_id", stable_part(f"part{seed}", F.col(key), n_parts))


def random_part_sizes(parted: DataFrame) -> DataFrame:
    """rows per part."""
    return parted.groupBy("part_id").agg(F.count(F.lit(1)).alias("n"))


def filter_part(parted: DataFrame, part: int) -> DataFrame:
    """The rows of one part."""
    return parted.where(F.col("part_id") == part)


def sample_hash(df: DataFrame, fraction: float, seed: int = 11, key: str = "key") -> DataFrame:
    """A4, stable twin: keep a row when its key's draw is below ``fraction``."""
    return df.where(stable_uniform(f"sample{seed}", F.col(key)) < F.lit(float(fraction)))


def sample_native(df: DataFrame, fraction: float, seed: int = 11) -> DataFrame:
    """A4 as in the reference: Bernoulli sample without replacement."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
