"""Estimators: built-in ones from ``pyspark.ml`` and those that need their own Spark jobs."""

from latewise.operators.models.boosting import BoostedTrees, GradientBoosting
from latewise.operators.models.decision_tree import DecisionTree, DecisionTreeModel
from latewise.operators.models.extra_trees import ExtraTrees, ExtraTreesModel
from latewise.operators.models.forest import ImportanceForest
from latewise.operators.models.knn import NearestNeighbours, NearestNeighboursModel
from latewise.operators.models.mlp import fit_mlp
from latewise.operators.models.registry import feature_importance, registry, score

__all__ = [
    "BoostedTrees", "DecisionTree", "DecisionTreeModel", "ExtraTrees", "ExtraTreesModel", "GradientBoosting",
    "ImportanceForest", "NearestNeighbours", "NearestNeighboursModel", "feature_importance", "fit_mlp", "registry", "score",
]
