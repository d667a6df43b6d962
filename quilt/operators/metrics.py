"""Evaluation (I1-I2) over one DataFrame that carries both prediction and
label (no positional zip of two lists).

AUC is exact: with the distinct scores in descending order, ``tp_i``/``fp_i``
the positives/negatives at score i and ``TP_<i`` the positives above it, the
trapezoid area under the ROC curve is ``sum(fp_i * (2 * TP_<i + tp_i)) / (2 * P
* N)``, in integers. The distinct scores are range-partitioned; positives above
are counted inside each partition and shifted by those of the partitions before
it, so no task sees more than its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quilt.session import cut_lineage


def accuracy(df: DataFrame, by: list[str] | None = None, pred: str = "prediction", label: str = "label") -> DataFrame:
    """``(by..., n, correct, accuracy_pct)``; accuracy is null on no rows."""
    hit = F.when(F.col(pred) == F.col(label), 1).otherwise(0)
    aggs = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hit), F.lit(0)).cast("bigint").alias("correct")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return g.withColumn("accuracy_pct", F.try_divide(F.col("correct").cast("double"), F.col("n")) * F.lit(100.0))


def auc(df: DataFrame, score: str = "prediction", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """``(by..., positives, negatives, auc)`` for a score (a class or a
    probability). Rows with a null or NaN score are left out; without both
    classes the AUC is null. One row per distinct score is sorted, a few bytes
    each; equal scores are merged before the shuffle."""
    by = by or []
    s = F.col(score).cast("double") + F.lit(0.0)  # -0.0 is 0.0
    pos = F.when(F.col(label) > 0, 1).otherwise(0)
    levels = (
        df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .select(*by, s.alias("__s"), pos.alias("__y")).groupBy(*by, "__s")
        .agg(F.sum("__y").cast("bigint").alias("__tp"), F.sum(1 - F.col("__y")).cast("bigint").alias("__fp"))
    )
    # the partition number is stored before it is read twice
    ranged = cut_lineage(levels.repartitionByRange(F.desc("__s")).withColumn("__pid", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__pid").agg(F.sum("__tp").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__pid").alias("__p"),
                          F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("bigint").alias("__shift"))
    same = F.col("__pid") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    within = Window.partitionBy(*by, "__pid").orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("__tp").over(within), F.lit(0)).cast("bigint")
    counted = ranged.withColumn("__above", above).join(shift, same)
    # exact in decimal(38,0): the products reach (rows)^2, beyond bigint at 10^10 rows
    wide = "decimal(38,0)"
    num = F.col("__fp").cast(wide) * (
        F.lit(2).cast(wide) * (F.col("__above") + F.col("__shift")).cast(wide) + F.col("__tp").cast(wide)
    )
    agg = [F.sum("__tp").alias("positives"), F.sum("__fp").alias("negatives"), F.sum(num).alias("__num")]
    g = counted.groupBy(*by).agg(*agg) if by else counted.agg(*agg)
    den = F.lit(2.0) * F.col("positives").cast("double") * F.col("negatives").cast("double")
    return g.select(
        *by,
        F.col("positives").cast("bigint").alias("positives"),
        F.col("negatives").cast("bigint").alias("negatives"),
        F.when(den > 0, F.col("__num").cast("double") / den).alias("auc"),
    )


def class_summaries(df: DataFrame, preds: dict[str, str], label: str = "label") -> DataFrame:
    """Accuracy and AUC of several 0/1 predictions of the same rows, one pass:
    ``(name, n, correct, accuracy_pct, positives, negatives, auc)``, a row for
    each name in ``preds`` (name: column). Both figures follow from the confusion
    counts. With P positives, N negatives, TP and FP the rows predicted 1, the
    two-level ROC area is ``(FP*TP + (N-FP)*(TP+P)) / (2PN)`` (the general formula
    above with two score levels). Rows without a prediction count for accuracy
    (as misses) but not for the AUC."""
    y = F.col(label) > 0

    def count(condition, name):
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(name)

    sums = [F.count(F.lit(1)).alias("n")]
    for i, column in enumerate(preds.values()):
        p = F.col(column)
        sums += [
            count(p == F.col(label), f"correct{i}"), count(p.isNotNull() & y, f"positives{i}"),
            count(p.isNotNull() & ~y, f"negatives{i}"), count((p > 0) & y, f"tp{i}"), count((p > 0) & ~y, f"fp{i}"),
        ]
    each = [
        F.struct(F.lit(name).alias("name"), *[F.col(f"{c}{i}").alias(c) for c in ("correct", "positives", "negatives", "tp", "fp")])
        for i, name in enumerate(preds)
    ]
    agg = df.agg(*sums).select("n", F.inline(F.array(*each)))
    P, N, TP, FP = (F.col(c).cast("decimal(38,0)") for c in ("positives", "negatives", "tp", "fp"))
    num = FP * TP + (N - FP) * (TP + P)
    den = F.lit(2.0) * F.col("positives").cast("double") * F.col("negatives").cast("double")
    return agg.select(
        "name",
        "n",
        "correct",
        (F.try_divide(F.col("correct").cast("double"), F.col("n")) * F.lit(100.0)).alias("accuracy_pct"),
        "positives",
        "negatives",
        F.when(den > 0, num.cast("double") / den).alias("auc"),
    )


def class_summary(df: DataFrame, pred: str = "prediction", label: str = "label") -> DataFrame:
    """Accuracy and AUC of one 0/1 prediction (see ``class_summaries``)."""
    return class_summaries(df, {"": pred}, label).drop("name")
