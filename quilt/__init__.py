"""quilt: partitioned logistic-model ensembles as Spark DataFrame jobs.

A table of labeled points is cut into pieces, either by an equi-depth merge of
the cells of a multi-dimensional grid or by a stable random part number; one
logistic model is fitted per piece with one distributed aggregate per
gradient step, and rows are scored by routing to their piece's model or by a
majority vote of all models.
"""

from quilt.functions.grid import Axis, Grid
from quilt.plans.api import HistogramEnsemble, RandomEnsemble, SingleModel, evaluate

__all__ = ["Axis", "Grid", "HistogramEnsemble", "RandomEnsemble", "SingleModel", "evaluate"]
