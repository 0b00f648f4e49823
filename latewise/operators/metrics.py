"""Classification metrics. Everything follows from one grouped confusion count.

A prediction table has ``y_true`` and ``y_pred``; ``by`` names further columns (for example the model)
for which the metrics are computed separately. After the first grouping every table has at most
classes x classes rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATES = ["precision", "recall", "f1", "specificity", "fpr", "fnr"]


def _ratio(num: Column, den: Column) -> Column:
    """num / den, or 0 where the denominator is 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"a row has no {name}")).cast("int"))


def confusion(pred: DataFrame, by: Sequence[str] = (), labels: list[int] | None = None) -> DataFrame:
    """(by, actual, predicted, n) over the full grid of classes.

    The classes are those seen as label or prediction, or exactly the given ones; with given labels,
    rows of other classes are left out. A row without a label or without a prediction is an error.
    """
    by = list(by)
    pred = pred.withColumns({c: _given(c) for c in ("y_true", "y_pred")})
    if labels is not None:
        pred = pred.filter(F.col("y_true").isin(labels) & F.col("y_pred").isin(labels))
    cells = pred.groupBy(*by, F.col("y_true").alias("actual"), F.col("y_pred").alias("predicted")).agg(
        F.count("*").alias("n")
    )
    seen = F.array_union(F.collect_set("actual"), F.collect_set("predicted"))
    classes = F.array(*[F.lit(c) for c in labels]) if labels is not None else F.col("classes")
    found = F.map_from_entries(F.collect_list(F.struct(F.struct("actual", "predicted"), "n"))).alias("cells")
    packed = cells.groupBy(*by).agg(F.array_sort(seen).alias("classes"), found)
    rows = packed.select(*by, "cells", classes.alias("classes"))
    rows = rows.select(*by, "cells", "classes", F.explode("classes").alias("actual"))
    rows = rows.select(*by, "cells", "actual", F.explode("classes").alias("predicted"))
    n = F.try_element_at("cells", F.struct("actual", "predicted"))
    return rows.select(*by, "actual", "predicted", F.coalesce(n, F.lit(0)).cast("long").alias("n"))


def class_counts(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, tp, fp, fn, tn)."""
    roles = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said"),
                 F.lit(0).cast("long").alias("tp")),
    )
    sums = (
        confusion.select(*by, F.explode(roles).alias("r")).select(*by, "r.*")
        .groupBy(*by, "class").agg(F.sum("true").alias("true"), F.sum("said").alias("said"), F.sum("tp").alias("tp"))
    )
    total = F.sum("true").over(Window.partitionBy(*by))
    return sums.select(
        *by, "class", "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("true") - F.col("tp")).alias("fn"),
        (total - F.col("true") - F.col("said") + F.col("tp")).alias("tn"),
    )


def class_metrics(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: support, precision, recall, F1, specificity, FPR, FNR and one-vs-rest accuracy."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return class_counts(confusion, by).select(
        *by, "class", "tp", "fp", "fn", "tn", (tp + fn).alias("support"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tn, tn + fp).alias("specificity"),
        _ratio(fp, fp + tn).alias("fpr"), _ratio(fn, fn + tp).alias("fnr"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("class_accuracy"),
    )


def summary_metrics(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: accuracy, macro and weighted means, balanced accuracy and MCC."""
    d = {c: F.col(c).cast("double") for c in ("tp", "fp", "fn", "support")}
    said = d["tp"] + d["fp"]
    total, hits = F.sum(d["support"]), F.sum(d["tp"])
    cross, said2, true2 = F.sum(said * d["support"]), F.sum(said * said), F.sum(d["support"] * d["support"])
    spread = (total * total - said2) * (total * total - true2)
    macro = [F.avg(c).alias(f"macro_{c}") for c in RATES]
    weighted = [_ratio(F.sum(F.col(c) * d["support"]), total).alias(f"weighted_{c}") for c in RATES]
    return class_metrics(confusion, by).groupBy(*by).agg(
        F.sum("support").alias("n"), _ratio(hits, total).alias("accuracy"), *macro, *weighted,
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.when(spread > 0, (hits * total - cross) / F.sqrt(spread)).otherwise(F.lit(0.0)).alias("mcc"),
    )


def accuracy(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*by).agg(
        F.avg(F.when(_given("y_true") == _given("y_pred"), 1.0).otherwise(0.0)).alias("accuracy")
    )


def classification_report(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class, then accuracy, macro avg and weighted avg; support is the number of true rows.

    The accuracy row carries its value in ``f1``; ``class_accuracy`` is filled for classes only.
    """
    matrix = confusion(pred, by)
    null = F.lit(None).cast("double")
    classes = class_metrics(matrix, by).select(
        *by, F.col("class").cast("string").alias("row"), "precision", "recall", "f1", "support", "class_accuracy",
    )
    whole = summary_metrics(matrix, by)
    rows = F.array(
        F.struct(F.lit("accuracy").alias("row"), null.alias("precision"), null.alias("recall"),
                 F.col("accuracy").alias("f1"), F.col("n").alias("support"), null.alias("class_accuracy")),
        *[
            F.struct(F.lit(f"{kind} avg").alias("row"), F.col(f"{kind}_precision").alias("precision"),
                     F.col(f"{kind}_recall").alias("recall"), F.col(f"{kind}_f1").alias("f1"),
                     F.col("n").alias("support"), null.alias("class_accuracy"))
            for kind in ("macro", "weighted")
        ],
    )
    return classes.unionByName(whole.select(*by, F.explode(rows).alias("r")).select(*by, "r.*"))


def confusion_json(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The matrix of each group as nested text, rows and columns in class order."""
    line = confusion.groupBy(*by, "actual").agg(
        F.array_sort(F.collect_list(F.struct("predicted", "n"))).alias("cells")
    )
    line = line.select(*by, "actual", F.transform("cells", lambda c: c["n"]).alias("counts"))
    rows = F.array_sort(F.collect_list(F.struct("actual", "counts")))
    return line.groupBy(*by).agg(
        F.to_json(F.transform(rows, lambda r: r["counts"])).alias("confusion_matrix")
    )
