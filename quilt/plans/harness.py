"""The reference's end-to-end runs, from delimited text files.

Read the training and test lines, drop every line containing the header
marker, take a Bernoulli sample of the lines if asked to, parse ``label,x1,...``, fit one
strategy, score the test lines and report accuracy and AUC, with the time
of each phase. The strategies and defaults are those of the reference's
three programs; everything runs as Spark jobs, nothing is collected.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.functions.grid import Grid
from quilt.plans.api import HistogramEnsemble, RandomEnsemble, SingleModel, evaluate
from quilt.sources.text import drop_marker_lines, parse_points, read_lines


def load_points(spark: SparkSession, path: str, width: int, marker: str | None = "Id",
                fraction: float | None = None, seed: int = 11, mode: str = "strict") -> DataFrame:
    # every line has a place of its own (file and number in it), so that equal
    # lines are drawn apart, as each row is in the reference
    place = F.concat_ws("|", F.col("_metadata.file_path"), F.monotonically_increasing_id().cast("string"))
    lines = drop_marker_lines(read_lines(spark, path).withColumn("key", place), marker)
    if fraction is not None:
        lines = lines.sample(withReplacement=False, fraction=fraction, seed=seed)
    return parse_points(lines, width, mode=mode, keep=["key"])


def run_text_flow(spark: SparkSession, train_path: str, test_path: str, width: int, strategy: str,
                  grid: Grid | None = None, n_pieces: int = 32, threshold: float = 0.499999,
                  iterations: int | None = None, **load) -> tuple[DataFrame, dict[str, float]]:
    """``strategy`` is ``histogram``, ``random`` or ``single``; returns the
    evaluation DataFrame and the seconds spent training and predicting."""
    feats = [f"x{i}" for i in range(width)]
    train = load_points(spark, train_path, width, **load)
    test = load_points(spark, test_path, width, **load)
    if strategy == "histogram":
        model = HistogramEnsemble(grid, n_pieces, threshold, iterations or 100)
    elif strategy == "random":
        model = RandomEnsemble(n_pieces, threshold, iterations or 100)
    elif strategy == "single":
        model = SingleModel(threshold, iterations or 10)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    times = {}
    t = time.time()
    model.fit(train, feats)
    times["train_sec"] = time.time() - t
    t = time.time()
    summary = evaluate(model.predict(test))
    summary = summary.cache()
    summary.count()
    times["predict_sec"] = time.time() - t
    return summary, times
