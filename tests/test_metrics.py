import numpy as np
import pytest
from pyspark.sql import functions as F

from latewise.operators import curves, losses, metrics, results


def predictions(spark, y, p, prob=None):
    rows = [(int(a), int(b), [float(v) for v in (prob[i] if prob is not None else [0.5, 0.5])]) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "y_true int, y_pred int, prob array<double>")


def scores(spark, y, s):
    return predictions(spark, y, [int(v >= 0.5) for v in s], [[1 - v, v] for v in s])


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def brute_ap(y, s):
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        total += (recall - last) * precision
        last = recall
    return total


def test_known_curve_values(spark):
    pred = scores(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1])
    row = curves.curve_areas(curves.binary_points(pred)).first()
    assert row["average_precision"] == pytest.approx(0.8333, abs=1e-4)
    # The curve starts at precision 1, recall 0, which here is also its first threshold's precision.
    assert row["pr_auc_trapezoid"] == pytest.approx(0.7917, abs=1e-4)
    assert row["roc_auc"] == pytest.approx(0.75)


@pytest.mark.parametrize("shuffle", ["2", "7", "64"])
def test_areas_match_brute_force_for_any_bucketing(spark, shuffle):
    rng = np.random.default_rng(5)
    s = np.where(rng.random(700) < 0.35, 0.5, np.round(rng.random(700), 3))
    y = (rng.random(700) < 0.3 + 0.3 * s).astype(int)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        row = curves.curve_areas(curves.binary_points(scores(spark, y, s))).first()
        roc = curves.roc_curve(curves.binary_points(scores(spark, y, s))).orderBy("threshold", ascending=False).collect()
        full = curves.roc_curve(curves.binary_points(scores(spark, y, s)), drop_collinear=False).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert row["roc_auc"] == pytest.approx(brute_auc(y, s))
    assert row["average_precision"] == pytest.approx(brute_ap(y, s))
    fpr, tpr = np.array([r["fpr"] for r in roc]), np.array([r["tpr"] for r in roc])
    assert (np.diff(fpr) >= 0).all() and (np.diff(tpr) >= 0).all()
    assert (fpr[0], tpr[0], fpr[-1], tpr[-1]) == (0, 0, 1, 1)
    assert np.trapezoid(tpr, fpr) == pytest.approx(row["roc_auc"])
    assert len(full) == len(set(s)) + 1 and len(roc) <= len(full)


def test_one_hot_score_and_single_class(spark):
    same = curves.curve_areas(curves.binary_points(scores(spark, [1, 0, 1], [0.4, 0.4, 0.4]))).first()
    assert same["roc_auc"] == pytest.approx(0.5) and same["average_precision"] == pytest.approx(2 / 3)
    one = curves.curve_areas(curves.binary_points(scores(spark, [1, 1], [0.4, 0.6]))).first()
    assert one["roc_auc"] == 0


def test_auc_agrees_with_the_built_in(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

    rng = np.random.default_rng(8)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    pred = scores(spark, y, s)
    raw = pred.select(F.col("y_true").cast("double").alias("label"), F.get("prob", F.lit(1)).alias("rawPrediction"))
    built_in = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(raw)
    assert curves.roc_auc(pred).first()[0] == pytest.approx(built_in)
    both = pred.select(F.col("y_true").cast("double").alias("label"), F.col("y_pred").cast("double").alias("prediction"))
    f1 = MulticlassClassificationEvaluator(metricName="f1").evaluate(both)
    assert metrics.summary_metrics(metrics.confusion(pred)).first()["weighted_f1"] == pytest.approx(f1)


def test_class_never_predicted_and_only_predicted(spark):
    pred = predictions(spark, [0, 0, 1, 1], [0, 0, 2, 0])
    rows = {r["class"]: r for r in metrics.class_metrics(metrics.confusion(pred)).collect()}
    assert set(rows) == {0, 1, 2}
    assert (rows[1]["precision"], rows[1]["recall"], rows[1]["f1"]) == (0, 0, 0)
    assert rows[2]["support"] == 0 and rows[2]["recall"] == 0 and rows[2]["fp"] == 1
    whole = metrics.summary_metrics(metrics.confusion(pred)).first()
    assert whole["accuracy"] == 0.5 and whole["balanced_accuracy"] == pytest.approx(0.5)
    assert sum(r["n"] for r in metrics.confusion(pred).collect()) == 4
    assert metrics.confusion(pred, labels=[0, 1]).count() == 4


def test_mcc_zero_denominator_and_value(spark):
    assert metrics.summary_metrics(metrics.confusion(predictions(spark, [0, 1], [0, 0]))).first()["mcc"] == 0
    y, p = [0, 0, 1, 1, 1, 0], [0, 1, 1, 1, 0, 0]
    got = metrics.summary_metrics(metrics.confusion(predictions(spark, y, p))).first()["mcc"]
    assert got == pytest.approx(np.corrcoef(y, p)[0, 1])


def test_losses(spark):
    pred = predictions(spark, [0, 1], [0, 1], [[0.8, 0.2], [0.4, 0.6]])
    assert losses.cross_entropy(pred).first()["log_loss"] == pytest.approx(-(np.log(0.8) + np.log(0.6)) / 2)
    expected = np.mean([0.65 * (1 - p) ** 3 * -np.log(p) for p in (0.8, 0.6)])
    assert losses.focal_loss(pred).first()["focal_loss"] == pytest.approx(expected)


def test_record_without_group(spark):
    row = results.metrics_record(scores(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]), 2).first()
    assert row["confusion_matrix"] == "[[1,1],[0,2]]" and row["roc_auc"] == pytest.approx(0.75)
    assert "_all" not in row.asDict()


def test_early_stopping(spark):
    def run(values, patience):
        h = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "run string, epoch int, val_f1 double")
        r = results.early_stopping(h, patience=patience).first()
        return r["best_epoch"], r["stop_epoch"], r["best"]

    assert run([0.1, 0.3, 0.3, 0.2, 0.9], 3) == (1, 4, 0.3) or run([0.1, 0.3, 0.3, 0.2, 0.9], 3) == (4, None, 0.9)
    assert run([0.1, 0.3, 0.3, 0.2, 0.1, 0.9], 3) == (1, 4, 0.3)
    assert run([0.1, 0.3, 0.2], 3) == (1, None, 0.3)
    assert run([0.0, 0.0, 0.0], 2) == (None, 1, None)


def test_best_model_first_wins_and_deltas(spark):
    table = spark.createDataFrame([("full", 0, 0.7), ("b", 1, 0.7), ("c", 2, 0.5)], "variant string, place int, f1 double")
    assert results.best_model(table).first()["variant"] == "full"
    deltas = {r["variant"]: r["f1_decline"] for r in results.ablation_deltas(table, "full", ["f1"]).collect()}
    assert deltas == {"b": 0.0, "c": pytest.approx(0.2)}


def test_missing_predictions_are_errors(spark):
    pred = spark.createDataFrame([(0, 0), (1, 1), (1, None)], "y_true int, y_pred int")
    for table in (metrics.confusion(pred), metrics.accuracy(pred)):
        with pytest.raises(Exception, match="y_pred"):
            table.collect()


def test_labels_other_than_zero_and_one(spark):
    pred = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.2, 0.8]), (1, [0.7, 0.3])], "y_true int, prob array<double>")
    assert curves.roc_auc(pred, classes=(1, 2)).first()[0] == 1.0
    areas = {r["class"]: r.roc_auc for r in curves.ovr_areas(pred, classes=(1, 2)).collect()}
    assert areas == {1: 1.0, 2: 1.0}
    for bad in (curves.roc_auc, curves.ovr_areas):
        with pytest.raises(Exception, match="no known class"):
            bad(pred).collect()
