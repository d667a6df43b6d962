"""Estimator-style entry points over any DataFrame of labeled points.

The points need a 0/1 ``label`` column and numeric feature columns (and a
``key`` column for the random ensemble's stable parts). Each ``fit`` runs the
distributed flow of the corresponding strategy; ``predict`` adds
``probability``/``ones`` and ``prediction`` without shuffling the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quilt.functions.grid import Grid
from quilt.operators.grouping import Grouping, equi_depth_groups, route
from quilt.operators.histogram import bin_histogram, with_bin_no
from quilt.operators.metrics import class_summary
from quilt.operators.partition import assign_random_part
from quilt.operators.score import predict_global, predict_routed, predict_vote
from quilt.operators.train import Models, fit
from quilt.session import cut_lineage


class HistogramEnsemble:
    """Grid cells merged into about ``n_groups`` equi-depth groups, one model
    per group, rows routed to their group's model."""

    def __init__(self, grid: Grid, n_groups: int, threshold: float = 0.5, iterations: int = 100,
                 policy: str = "clamp", compatible: bool = True):
        self.grid, self.n_groups, self.threshold = grid, n_groups, threshold
        self.iterations, self.policy, self.compatible = iterations, policy, compatible
        self.grouping: Grouping | None = None
        self.models: Models | None = None
        self.counts: DataFrame | None = None

    def fit(self, points: DataFrame, features: list[str]) -> "HistogramEnsemble":
        self.counts = cut_lineage(bin_histogram(points, self.grid, self.policy))
        self.grouping = equi_depth_groups(self.counts, self.grid, self.n_groups)
        routed = route(with_bin_no(points, self.grid, self.policy), self.grouping, compatible=self.compatible)
        self.models = fit(routed, features, "group_id", self.iterations)
        return self

    def route(self, df: DataFrame) -> DataFrame:
        return route(with_bin_no(df, self.grid, self.policy), self.grouping, compatible=self.compatible)

    def predict(self, df: DataFrame) -> DataFrame:
        return predict_routed(self.route(df), self.models, "group_id", self.threshold)


class RandomEnsemble:
    """Rows dealt to ``n_parts`` parts by a stable hash of ``key``, one model
    per part, every row scored by a majority vote (a tie gives 0)."""

    def __init__(self, n_parts: int, threshold: float = 0.5, iterations: int = 100, seed: int = 11,
                 key: str = "key"):
        self.n_parts, self.threshold, self.iterations, self.seed, self.key = n_parts, threshold, iterations, seed, key
        self.models: Models | None = None

    def fit(self, points: DataFrame, features: list[str]) -> "RandomEnsemble":
        parted = assign_random_part(points, self.n_parts, self.seed, self.key)
        self.models = fit(parted, features, "part_id", self.iterations)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return predict_vote(df, self.models, self.threshold)


class SingleModel:
    """One model on all rows."""

    def __init__(self, threshold: float = 0.5, iterations: int = 10):
        self.threshold, self.iterations = threshold, iterations
        self.models: Models | None = None

    def fit(self, points: DataFrame, features: list[str]) -> "SingleModel":
        self.models = fit(points, features, None, self.iterations)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return predict_global(df, self.models, self.threshold)


def evaluate(scored: DataFrame) -> DataFrame:
    """Accuracy (%) and area under the ROC curve of 0/1 predictions, one pass."""
    return class_summary(scored)
