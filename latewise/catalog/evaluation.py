"""Queries: metrics, curves, losses and experiment tables over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.catalog import sql as S
from latewise.catalog.registry import query, r, rounded
from latewise.operators import curves, losses, metrics, results
from latewise.sources.order_items import binary_predictions, multi_predictions

_FIVE = f"WITH {S.MULTI}, {S.counts_by_class()}"


@query("confusion_matrix", f"""
WITH {S.MULTI}, classes AS (SELECT DISTINCT y_true AS c FROM pred UNION SELECT y_pred FROM pred)
SELECT a.c AS actual, b.c AS predicted, count(row_key) AS n FROM classes a CROSS JOIN classes b
LEFT JOIN pred ON y_true = a.c AND y_pred = b.c GROUP BY 1, 2""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(multi_predictions(spark, sf_dir))


@query("class_counts", f"{_FIVE} SELECT class, tp, fp, fn, tn FROM class_counts")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_counts(metrics.confusion(multi_predictions(spark, sf_dir)))


def _class_metrics(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    table = metrics.class_metrics(metrics.confusion(multi_predictions(spark, sf_dir)))
    return rounded(table, [c for c in cols if c != "support"]).select("class", *cols)


@query("class_prf", f"""{_FIVE}
SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM class_metrics""")
def class_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_metrics(spark, sf_dir, "precision", "recall", "f1", "support")


@query("class_rates", f"""{_FIVE}
SELECT class, round(specificity, 6) AS specificity, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr FROM class_metrics""")
def class_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_metrics(spark, sf_dir, "specificity", "fpr", "fnr")


@query("ovr_accuracy", f"{_FIVE} SELECT class, round(class_accuracy, 6) AS class_accuracy FROM class_metrics")
def ovr_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_metrics(spark, sf_dir, "class_accuracy")


def _summary(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    table = metrics.summary_metrics(metrics.confusion(multi_predictions(spark, sf_dir)))
    return table.select(*[r(c).alias(c) for c in cols])


_MEANS = [c for c in S.SUMMARY_COLUMNS if c.startswith(("macro", "weighted"))]


@query("macro_weighted", f"{_FIVE}, {S.summary()} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in _MEANS)} FROM summary")
def macro_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, *_MEANS)


@query("balanced_accuracy", f"{_FIVE}, {S.summary()} SELECT round(balanced_accuracy, 6) AS balanced_accuracy FROM summary")
def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "balanced_accuracy")


@query("mcc", f"{_FIVE}, {S.summary()} SELECT round(mcc, 6) AS mcc FROM summary")
def mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "mcc")


@query("accuracy", f"WITH {S.BINARY} SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM pred")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(binary_predictions(spark, sf_dir)).select(r("accuracy").alias("accuracy"))


_POSITIVE = "(SELECT *, y_true AS positive FROM pred)"
_BINARY_AREAS = f"WITH {S.BINARY}, {S.areas('', _POSITIVE)}"


@query("roc_curve", f"""{_BINARY_AREAS}
SELECT round(score, 6) AS threshold, round(fp / nn::DOUBLE, 6) AS fpr, round(tp / np::DOUBLE, 6) AS tpr FROM ranked
WHERE (tp = pos AND fp = neg) OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg
UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0""")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = curves.roc_curve(curves.binary_points(binary_predictions(spark, sf_dir)))
    return rounded(curve, ["threshold", "fpr", "tpr"])


@query("pr_curve", f"""{_BINARY_AREAS}
SELECT round(score, 6) AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS "precision", round(tp / np::DOUBLE, 6) AS recall FROM ranked
UNION ALL SELECT NULL, 1, 0""")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = curves.pr_curve(curves.binary_points(binary_predictions(spark, sf_dir)))
    return rounded(curve, ["threshold", "precision", "recall"])


@query("roc_auc", f"{_BINARY_AREAS} SELECT round(roc_auc, 6) AS roc_auc FROM areas")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.roc_auc(binary_predictions(spark, sf_dir)), ["roc_auc"])


@query("roc_auc_other_labels", f"""WITH {S.BINARY}, {S.areas('', _POSITIVE)}
SELECT round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM areas""")
def roc_auc_other_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas where the labels are 1 and 2 instead of 0 and 1."""
    pred = binary_predictions(spark, sf_dir).withColumn("y_true", F.col("y_true") + 1)
    areas = curves.curve_areas(curves.binary_points(pred, classes=(1, 2)))
    return rounded(areas.select("roc_auc", "average_precision"), ["roc_auc", "average_precision"])


@query("average_precision", f"{_BINARY_AREAS} SELECT round(average_precision, 6) AS average_precision FROM areas")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.average_precision(binary_predictions(spark, sf_dir)), ["average_precision"])


@query("pr_auc_trapezoid", f"{_BINARY_AREAS} SELECT round(pr_auc_trapezoid, 6) AS pr_auc_trapezoid FROM areas")
def pr_auc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.pr_auc_trapezoid(binary_predictions(spark, sf_dir)), ["pr_auc_trapezoid"])


_OVR_AREAS = f"WITH {S.MULTI}, {S.areas('class,', 'cells')}"


_TURNS = "(tp = pos AND fp = neg) OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg"


@query("roc_curve_ovr", f"""{_OVR_AREAS}
SELECT class, round(score, 6) AS threshold, round(fp / nn::DOUBLE, 6) AS fpr, round(tp / np::DOUBLE, 6) AS tpr FROM ranked WHERE {_TURNS}
UNION ALL SELECT DISTINCT class, 'Infinity'::DOUBLE, 0, 0 FROM ranked""")
def roc_curve_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ROC points of each class against the rest."""
    curve = curves.roc_curve(curves.ovr_points(multi_predictions(spark, sf_dir)), ["class"])
    return rounded(curve, ["threshold", "fpr", "tpr"])


@query("pr_curve_ovr", f"""{_OVR_AREAS}
SELECT class, round(score, 6) AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS "precision", round(tp / np::DOUBLE, 6) AS recall FROM ranked
UNION ALL SELECT DISTINCT class, NULL::DOUBLE, 1, 0 FROM ranked""")
def pr_curve_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The precision-recall points of each class against the rest."""
    curve = curves.pr_curve(curves.ovr_points(multi_predictions(spark, sf_dir)), ["class"])
    return rounded(curve, ["threshold", "precision", "recall"])


@query("roc_curve_micro", f"""WITH {S.MULTI}, {S.areas('', 'cells')}
SELECT round(score, 9) AS threshold, round(fp / nn::DOUBLE, 9) AS fpr, round(tp / np::DOUBLE, 9) AS tpr FROM ranked WHERE {_TURNS}
UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0""")
def roc_curve_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ROC points over all (row, class) cells together."""
    curve = curves.roc_curve(curves.ovr_points(multi_predictions(spark, sf_dir)).drop("class"))
    return rounded(curve, ["threshold", "fpr", "tpr"], 9)


def _ovr(name: str, sql_name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Area per class and, in the row without a class, the mean weighted by class size."""
        areas = curves.ovr_areas(multi_predictions(spark, sf_dir))
        both = areas.select(F.col("class").cast("int"), name, "positives")
        total = curves.weighted_ovr(areas).select(F.lit(None).cast("int").alias("class"), name)
        return rounded(both.drop("positives").unionByName(total), [name])

    run.__name__ = sql_name
    return run


for _metric, _name in (("roc_auc", "roc_auc_ovr"), ("average_precision", "average_precision_ovr")):
    query(_name, f"""{_OVR_AREAS}
SELECT class, round({_metric}, 6) AS {_metric} FROM areas
UNION ALL SELECT NULL, round(sum({_metric} * positives) / sum(positives), 6) FROM areas""")(_ovr(_metric, _name))


@query("micro_auc", f"""WITH {S.MULTI}, {S.areas('', 'cells')}
SELECT round(roc_auc, 6) AS roc_auc, round(pr_auc_trapezoid, 6) AS pr_auc_trapezoid FROM areas""")
def micro_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.micro_auc(multi_predictions(spark, sf_dir)), ["roc_auc", "pr_auc_trapezoid"])


_P_TRUE = "CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END"


@query("log_loss", f"WITH {S.MULTI} SELECT y_true, count(*) AS n, round(avg(-ln({_P_TRUE})), 6) AS log_loss FROM pred GROUP BY 1")
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(losses.cross_entropy(multi_predictions(spark, sf_dir), ["y_true"]), ["log_loss"])


@query("focal_loss", f"""
WITH {S.MULTI}
SELECT y_true, count(*) AS n, round(avg(0.65::DOUBLE * pow(1 - {_P_TRUE}, 3) * -ln({_P_TRUE})), 6) AS focal_loss FROM pred GROUP BY 1""")
def focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(losses.focal_loss(multi_predictions(spark, sf_dir), ["y_true"]), ["focal_loss"])


@query("classification_report", f"""{_FIVE}, {S.summary()}
SELECT CAST(class AS VARCHAR) AS row, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1,
  support, round(class_accuracy, 6) AS class_accuracy FROM class_metrics
UNION ALL SELECT 'accuracy', NULL, NULL, round(accuracy, 6), n, NULL FROM summary
UNION ALL SELECT 'macro avg', round(macro_precision, 6), round(macro_recall, 6), round(macro_f1, 6), n, NULL FROM summary
UNION ALL SELECT 'weighted avg', round(weighted_precision, 6), round(weighted_recall, 6), round(weighted_f1, 6), n, NULL FROM summary""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.classification_report(multi_predictions(spark, sf_dir))
    return rounded(report, ["precision", "recall", "f1", "class_accuracy"])


_PLAIN = {"macro_precision": "precision", "macro_recall": "recall", "macro_f1": "f1"}
_RECORD = [_PLAIN.get(c, c) for c in S.SUMMARY_COLUMNS] + ["roc_auc", "pr_auc"]


def record_sql(pred: str, group: str, source: str, area_group: str, areas_final: str) -> str:
    """CTE ``record``: summary, areas and confusion text of each model."""
    return f"""{S.counts_by_class("model,", pred)}, {S.summary("model,")}, {S.areas(area_group, source)}, {areas_final},
grid AS (
  SELECT a.model, a.class AS actual, b.class AS predicted, count(p.y_true) AS n FROM class_counts a
  JOIN class_counts b ON a.model = b.model
  LEFT JOIN {pred} p ON p.model = a.model AND y_true = a.class AND y_pred = b.class GROUP BY 1, 2, 3),
lines AS (SELECT model, actual, '[' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY predicted) || ']' AS line FROM grid GROUP BY 1, 2),
matrix AS (SELECT model, '[' || string_agg(line, ',' ORDER BY actual) || ']' AS confusion_matrix FROM lines GROUP BY 1),
record AS (
  SELECT model, n, {", ".join(f"{c} AS {_PLAIN[c]}" if c in _PLAIN else c for c in S.SUMMARY_COLUMNS)}, roc_auc, pr_auc, confusion_matrix
  FROM summary JOIN final USING (model) JOIN matrix USING (model))"""


_BY_MODEL = f"""{S.BINARY}, scored AS (SELECT shipping_mode AS model, y_true, y_pred, score, y_true AS positive FROM pred), """
_BINARY_RECORD = f"WITH {_BY_MODEL} " + record_sql(
    "scored", "model,", "scored", "model,", "final AS (SELECT model, roc_auc, average_precision AS pr_auc FROM areas)"
)


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per shipping mode, taken as the name of a model."""
    pred = binary_predictions(spark, sf_dir, "shipping_mode").withColumnRenamed("shipping_mode", "model")
    return results.metrics_record(pred, 2, ["model"])


@query("metrics_record", f"""{_BINARY_RECORD}
SELECT model, n, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _RECORD)}, confusion_matrix FROM record""")
def metrics_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model_results(spark, sf_dir), _RECORD)


_MULTI_RECORD = f"""WITH {S.MULTI}, scored AS (SELECT l_returnflag AS model, pred.* FROM pred JOIN
  (SELECT {S.ROW_KEY} AS row_key, l_returnflag FROM lineitem) USING (row_key)),
scored_cells AS (SELECT model, class, score, positive FROM cells JOIN (SELECT row_key, model FROM scored) USING (row_key)), """ + record_sql(
    "scored", "model,", "scored_cells", "model, class,",
    "final AS (SELECT model, sum(roc_auc * positives) / sum(positives) AS roc_auc, "
    "sum(average_precision * positives) / sum(positives) AS pr_auc FROM areas GROUP BY 1)",
)


@query("metrics_record_five", f"""{_MULTI_RECORD}
SELECT model, n, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _RECORD)}, confusion_matrix FROM record""")
def metrics_record_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-class records, one per order type."""
    pred = multi_predictions(spark, sf_dir, "type").withColumnRenamed("type", "model")
    return rounded(results.metrics_record(pred, 5, ["model"]), _RECORD)


_COMPARED = [c for c in results.COMPARED if c != "train_time"]


@query("model_comparison", f"""{_BINARY_RECORD}
SELECT model, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _COMPARED)} FROM record""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.comparison(model_results(spark, sf_dir)), _COMPARED)


@query("best_model", f"{_BINARY_RECORD} SELECT model, round(f1, 6) AS f1, round(mcc, 6) AS mcc FROM record ORDER BY f1 DESC, model LIMIT 1")
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = results.best_model(model_results(spark, sf_dir), "f1", order="model")
    return best.select("model", r("f1").alias("f1"), r("mcc").alias("mcc"))


@query("ablation_deltas", f"""{_BINARY_RECORD}
SELECT v.model AS variant, {", ".join(f"round(f.{m} - v.{m}, 6) + 0.0 AS {m}_decline" for m in results.ABLATION_METRICS)}
FROM record v JOIN record f ON f.model = '1-URGENT' WHERE v.model <> '1-URGENT'""")
def ablation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first shipping mode as the full variant, the others as reduced ones."""
    table = model_results(spark, sf_dir).withColumnRenamed("model", "variant")
    deltas = results.ablation_deltas(table, "1-URGENT")
    return rounded(deltas, [f"{m}_decline" for m in results.ABLATION_METRICS])


@query("early_stopping", f"""
WITH {S.BINARY}, weekly AS (
  SELECT shipping_mode AS run, CAST(date_diff('day', DATE '1970-01-01', CAST(order_date AS DATE)) // 7 AS INTEGER) AS epoch, y_true, y_pred FROM pred),
{S.counts_by_class("run, epoch,", "weekly")}, {S.summary("run, epoch,")},
history AS (SELECT run, epoch, round(macro_f1, 6) AS v, row_number() OVER (PARTITION BY run ORDER BY epoch) AS step FROM summary),
marked AS (
  SELECT *, v > greatest(0, coalesce(max(v) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS better FROM history),
waited AS (
  SELECT *, step - coalesce(max(CASE WHEN better THEN step END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS wait FROM marked),
stops AS (SELECT run, min(step) AS stop FROM waited WHERE wait >= 30 GROUP BY 1)
SELECT w.run, arg_max(epoch, CASE WHEN better THEN step END) AS best_epoch, max(CASE WHEN wait >= 30 THEN epoch END) AS stop_epoch,
  max(CASE WHEN better THEN v END) AS best
FROM waited w LEFT JOIN stops s ON s.run = w.run WHERE stop IS NULL OR step <= stop GROUP BY 1""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks as epochs and shipping modes as runs: macro F1 of each week's scored rows."""
    day = F.unix_date(F.col("order_date").cast("date"))
    pred = binary_predictions(spark, sf_dir, "shipping_mode", "order_date")
    pred = pred.select("y_true", "y_pred", F.col("shipping_mode").alias("run"), F.floor(day / 7).cast("int").alias("epoch"))
    weekly = metrics.summary_metrics(metrics.confusion(pred, ["run", "epoch"]), ["run", "epoch"])
    history = weekly.select("run", "epoch", r("macro_f1").alias("val_f1"))
    return results.early_stopping(history, "val_f1", patience=30)
