"""Scoring a stream of points with fitted models (Structured Streaming).

Scoring is stateless per row: a projection (single model, vote) or a
stream-static broadcast join (routing through the grouping's level tables and
the model table), so the batch operators apply to a streaming DataFrame as
they are. The running quality summary is a streaming aggregation whose state
Spark keeps in the query's checkpoint, so a restarted query resumes its
counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quilt.functions.grid import Grid
from quilt.operators.grouping import Grouping, route
from quilt.operators.histogram import with_bin_no
from quilt.operators.metrics import class_summary
from quilt.operators.score import predict_global, predict_routed, predict_vote
from quilt.operators.train import Models
from quilt.session import ensure_checkpoint_dir


def read_points_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Parquet files of points ``(key, label, x0..)`` arriving in ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def score_stream(
    stream: DataFrame,
    models: Models,
    kind: str,
    threshold: float,
    grouping: Grouping | None = None,
    grid: Grid | None = None,
    policy: str = "clamp",
) -> DataFrame:
    """``kind`` is ``single``, ``histogram`` (needs grouping and grid) or ``random``."""
    if kind == "single":
        return predict_global(stream, models, threshold)
    if kind == "random":
        return predict_vote(stream, models, threshold)
    if kind == "histogram":
        routed = route(with_bin_no(stream, grid, policy), grouping)
        return predict_routed(routed, models, "group_id", threshold)
    raise ValueError(f"unknown strategy {kind!r}")


def running_summary(scored: DataFrame) -> DataFrame:
    """Streaming aggregate of the rows, accuracy and class AUC."""
    return class_summary(scored).select("n", "correct", "accuracy_pct", "auc")


def start(df: DataFrame, name: str, sink: str, checkpoint: str | None = None,
          mode: str = "append", path: str | None = None) -> StreamingQuery:
    """Start a query; its checkpoint goes under the shared checkpoint folder
    unless given, so a restarted query continues where it stopped."""
    base = checkpoint or f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stream-{name}"
    w = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", base).format(sink)
    return w.start(path) if path else w.start()
