"""The study's classifiers by name, and scoring of any fitted one."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.classification import (
    LogisticRegression,
    NaiveBayes,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewise.functions import normalize_probs
from latewise.operators.models.boosting import GradientBoosting
from latewise.operators.models.decision_tree import DecisionTree
from latewise.operators.models.extra_trees import ExtraTrees
from latewise.operators.models.forest import ImportanceForest
from latewise.operators.models.knn import NearestNeighbours


def registry(n_train: int, n_classes: int, key: str = "row_key", seed: int = 42) -> dict:
    """Name to estimator with the study's settings.

    The logistic penalty is 1 / (C n) with C = 1, which makes the built-in objective equal to a sum of
    losses plus half the squared weights. The two boostings differ as the study's do by default: the first grows all
    leaves of a level and penalizes them, the second grows the best leaf first, up to 31, of 20 rows or more.
    """
    boosted = GradientBoosting(
        n_trees=200, max_depth=5, learning_rate=0.01, row_share=0.8, column_share=0.8, n_classes=n_classes, seed=seed, key=key
    )
    return {
        "boosted_trees": boosted,
        "boosted_trees_fine": replace(
            boosted, max_bins=255, max_leaves=31, reg_lambda=0.0, min_hess=1e-3, min_rows=20, row_share=1.0
        ),
        "RandomForest": RandomForestClassifier(numTrees=300, maxDepth=5, featureSubsetStrategy="sqrt", seed=seed),
        "DecisionTree": DecisionTree(max_depth=5),
        "LogisticRegression": LogisticRegression(
            maxIter=1000, regParam=1.0 / n_train, elasticNetParam=0.0, standardization=False
        ),
        "KNN": NearestNeighbours(key=key, k=10),
        "NaiveBayes": NaiveBayes(modelType="gaussian"),
        "ExtraTrees": ExtraTrees(n_trees=200, max_depth=5, seed=seed),
    }


def _one_vs_rest(model: OneVsRestModel, df: DataFrame) -> DataFrame:
    """The positive probability of every sub-model side by side, scaled to sum to 1."""
    names = []
    for i, sub in enumerate(model.models):
        extra = {sub.probabilityCol: f"_p{i}", sub.rawPredictionCol: f"_r{i}", sub.predictionCol: f"_y{i}"}
        df = sub.copy(extra).transform(df).drop(f"_r{i}", f"_y{i}")
        names.append(f"_p{i}")
    probs = F.array(*[vector_to_array(n)[1] for n in names])
    return df.withColumn("probability", normalize_probs(probs)).drop(*names)


def score(model, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, y_true, y_pred, prob) of a labelled vector table; one pass, no shuffle but for KNN."""
    if isinstance(model, OneVsRestModel):
        scored = _one_vs_rest(model, df)
        best = F.array_position("probability", F.array_max("probability")) - 1
        scored = scored.withColumn("prediction", best.cast("double"))
    else:
        scored = model.transform(df)
    kind = dict(scored.dtypes)["probability"]
    prob = vector_to_array("probability") if kind == "vector" else F.col("probability")
    return scored.select(
        *keep, F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
        prob.alias("prob"),
    )


def feature_importance(df: DataFrame, cols: list[str], label: str, trees: int = 100, top: int = 15, seed: int = 42) -> DataFrame:
    """The columns with the largest impurity importance in a forest of fully grown trees (importances sum to 1)."""
    rows = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("features"), F.col(label).cast("int").alias("label"))
    importances = ImportanceForest(n_trees=trees, seed=seed).importances(rows).tolist()
    table = df.sparkSession.createDataFrame(list(zip(cols, importances)), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)
