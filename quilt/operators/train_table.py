"""Training of very many models (G2, G3) with the weights as a table.

The update rule is that of ``train``; here no weight passes the driver. The rows
are dealt once by (model, salt), where only a model with more than
``rows_per_cell`` rows has several salts, and kept. In a step the weights, dealt
alike, meet them in a join that does not move the rows; gradients are summed
where the rows are, and the sums of the few salts of a model in a small shuffle
give the next weights: the plan refers to the weights before it once. Every
``every`` steps they are written to the checkpoint folder, which cuts the lineage,
so that the loss of an executor costs at most these steps.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.functions.logistic import dot, sigmoid, usable
from quilt.session import broadcast_if_small, cut_lineage, persist

ROWS_PER_CELL = 200_000


def fit_table(
    points: DataFrame, features: list[str], model_col: str, iterations: int = 100, step: float = 1.0,
    partitions: int | None = None, rows_per_cell: int = ROWS_PER_CELL, every: int = 5,
) -> DataFrame:
    """``(model_id, n, w0, ..)``: one row per distinct ``model_col`` value with
    usable rows. ``partitions``: of the kept rows; by default those of a shuffle."""
    spark = points.sparkSession
    k = len(features)
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mid = F.col(model_col).cast("bigint")
    cols = [F.col(c).cast("double") for c in features]
    rows = points.where(mid.isNotNull() & usable(cols)).select(
        mid.alias("model_id"), F.col("label").cast("double").alias("label"), *[c.alias(f"x{j}") for j, c in enumerate(cols)]
    )
    bad = F.sum(F.when(F.col("label").isin(0.0, 1.0), 0).otherwise(1))
    salts = F.ceil(F.col("n") / F.lit(rows_per_cell)).cast("int")
    models = cut_lineage(
        rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).withColumn("salts", salts)
    )
    if models.where("bad > 0").limit(1).count():
        raise ValueError("training labels must be 0 or 1 (binary logistic models)")
    hot = models.where("salts > 1").select("model_id", "salts")
    salted = rows.join(broadcast_if_small(hot, hot.count(), 2), "model_id", "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("label", *[f"x{j}" for j in range(k)]), "salts")).cast("int")
    )
    data = persist(salted.drop("salts").repartition(p, "model_id", "salt"))
    ws = [f"w{j}" for j in range(k)]
    weights = models.select("model_id", "n", "salts", *[F.lit(0.0).alias(w) for w in ws])
    try:
        for t in range(1, iterations + 1):
            cells = weights.select(
                "model_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "n", "salts", *ws
            ).repartition(p, "model_id", "salt")
            r = sigmoid(dot([F.col(f"x{j}") for j in range(k)], [F.col(w) for w in ws])) - F.col("label")
            held = [F.first(c).alias(c) for c in ("n", "salts", *ws)]
            met = data.join(cells, ["model_id", "salt"]).withColumn("r", r)
            sums = met.groupBy("model_id", "salt").agg(*held, *[F.sum(F.col("r") * F.col(f"x{j}")).alias(f"g{j}") for j in range(k)])
            sums = sums.groupBy("model_id").agg(*held, *[F.sum(f"g{j}").alias(f"g{j}") for j in range(k)])
            rate = F.lit(step / math.sqrt(t))
            weights = sums.select(
                "model_id", "n", "salts", *[(F.col(w) - rate * (F.col(f"g{j}") / F.col("n"))).alias(w) for j, w in enumerate(ws)]
            )
            if t % every == 0 or t == iterations:
                weights = cut_lineage(weights)
    finally:
        data.unpersist()
    return weights.drop("salts")
