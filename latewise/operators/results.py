"""Tables of model results: one record per model, comparison, best model, ablation, early stopping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latewise.operators.curves import binary_points, curve_areas, ovr_areas, weighted_ovr
from latewise.operators.metrics import confusion, confusion_json, summary_metrics

# The columns the study compares and the metrics its ablation reports.
COMPARED = [
    "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "mcc", "balanced_accuracy",
    "weighted_fpr", "weighted_fnr", "train_time",
]
ABLATION_METRICS = ["accuracy", "f1", "roc_auc", "mcc"]


def metrics_record(pred: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """All metrics of each group in one row: a confusion job and a curve job, joined on ``by``.

    With two classes the areas are those of the second class; otherwise one-vs-rest, weighted by class
    size. ``pr_auc`` is the average precision.
    """
    if not by:
        whole = metrics_record(pred.withColumn("_all", F.lit(0)), n_classes, ["_all"])
        return whole.drop("_all")
    by = list(by)
    matrix = confusion(pred, by)
    if n_classes == 2:
        areas = curve_areas(binary_points(pred, by), by)
    else:
        areas = weighted_ovr(ovr_areas(pred, by), by)
    areas = areas.select(*by, "roc_auc", F.col("average_precision").alias("pr_auc"))
    record = summary_metrics(matrix, by)
    for part in (areas, confusion_json(matrix, by)):
        record = record.join(part, by)
    plain = {f"macro_{c}": c for c in ("precision", "recall", "f1")}
    return record.withColumnsRenamed(plain)


def comparison(results: DataFrame) -> DataFrame:
    """The compared metrics of each model."""
    return results.select("model", *[c for c in COMPARED if c in results.columns])


def best_model(results: DataFrame, metric: str = "f1", order: str = "place") -> DataFrame:
    """The record with the largest metric; the earlier one wins a tie."""
    return results.orderBy(F.desc(metric), order).limit(1)


def ablation_deltas(
    results: DataFrame, baseline: str, metrics: Sequence[str] = tuple(ABLATION_METRICS), name: str = "variant"
) -> DataFrame:
    """Full minus variant for every variant but the full one. ``results`` has one row per variant."""
    everything = Window.partitionBy()
    full = {m: F.max(F.when(F.col(name) == baseline, F.col(m))).over(everything) for m in metrics}
    with_full = results.select(name, *[(full[m] - F.col(m)).alias(f"{m}_decline") for m in metrics])
    return with_full.filter(F.col(name) != baseline)


def early_stopping(history: DataFrame, metric: str = "val_f1", patience: int = 30) -> DataFrame:
    """(run, best_epoch, stop_epoch, best): the best epoch reached before training would have stopped.

    An epoch counts as better only if it is strictly above everything before it and above 0. Training
    stops at the first epoch that is the ``patience``-th in a row without a better one.
    """
    order = Window.partitionBy("run").orderBy("epoch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = history.select(
        "run", "epoch", F.col(metric).alias("value"), F.row_number().over(order).alias("step"),
        F.coalesce(F.max(metric).over(before), F.lit(0.0)).alias("best_before"),
    )
    steps = steps.withColumn("better", F.col("value") > F.greatest("best_before", F.lit(0.0)))
    last_better = F.coalesce(F.max(F.when(F.col("better"), F.col("step"))).over(upto), F.lit(0))
    steps = steps.withColumn("stalled", F.col("step") - last_better >= patience)
    first_stop = F.min(F.when(F.col("stalled"), F.col("step"))).over(Window.partitionBy("run"))
    seen = steps.withColumn("stop", first_stop).filter(F.col("stop").isNull() | (F.col("step") <= F.col("stop")))
    return seen.groupBy("run").agg(
        F.max_by("epoch", F.when(F.col("better"), F.col("step"))).alias("best_epoch"),
        F.max(F.when(F.col("stalled"), F.col("epoch"))).alias("stop_epoch"),
        F.max(F.when(F.col("better"), F.col("value"))).alias("best"),
    )
