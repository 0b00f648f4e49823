"""ROC and precision-recall curves and the areas under them.

Rows with the same score are counted together first (inside each task before the shuffle), so a very
frequent score is one row afterwards. The running counts along descending scores are not taken in one
task: distinct scores are cut into buckets of similar size by sampled quantiles, counted inside each
bucket, and shifted by the totals of the buckets above. The result does not depend on where the cuts are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(points: DataFrame) -> DataFrame:
    """Add ``bucket``: the place of the score among quantiles of all scores."""
    spark = points.sparkSession
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = points.agg(F.percentile_approx("score", shares, max(10_000, 10 * buckets)).alias("q")).first()["q"]
    cuts = sorted({b for b in bounds or []} - {float("inf"), float("-inf")}) or [0.5]
    splitter = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="score", outputCol="bucket", handleInvalid="error"
    )
    return splitter.transform(points).withColumn("bucket", F.col("bucket").cast("int"))


def ranked_counts(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct score: pos, neg, the running tp and fp, and the group totals P and N.

    ``points`` has ``score`` (double) and ``positive`` (0/1). ``next_pos`` and ``next_neg`` are the
    counts at the next lower score (null at the last one).
    """
    by = list(by)
    scores = _bucketed(points).groupBy(*by, "bucket", "score").agg(
        F.sum(F.col("positive").cast("long")).alias("pos"),
        F.sum(1 - F.col("positive").cast("long")).alias("neg"),
    )
    cells = scores.groupBy(*by, "bucket").agg(
        F.sum("pos").alias("cell_pos"), F.sum("neg").alias("cell_neg"),
        F.max_by(F.struct("pos", "neg"), "score").alias("first"),
    )
    down = Window.partitionBy(*by).orderBy(F.desc("bucket"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    cells = cells.select(
        *by, "bucket",
        F.coalesce(F.sum("cell_pos").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("cell_neg").over(above), F.lit(0)).alias("neg_above"),
        F.lead("first").over(down).alias("below"),
        F.sum("cell_pos").over(whole).alias("P"), F.sum("cell_neg").over(whole).alias("N"),
    )
    inside = Window.partitionBy(*by, "bucket").orderBy(F.desc("score"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    after = F.lead(F.struct("pos", "neg")).over(inside)
    local = scores.select(
        *by, "bucket", "score", "pos", "neg", F.sum("pos").over(running).alias("pos_run"),
        F.sum("neg").over(running).alias("neg_run"), after.alias("after"),
    )
    # One row per group and bucket on the right: at most groups x shuffle partitions.
    joined = local.alias("l").join(
        cells.alias("c"), [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*by, "bucket"]]
    )
    following = F.coalesce(F.col("after"), F.col("below"))
    return joined.select(
        *[F.col(f"l.{k}").alias(k) for k in by], "score", "pos", "neg",
        (F.col("pos_above") + F.col("pos_run")).alias("tp"), (F.col("neg_above") + F.col("neg_run")).alias("fp"),
        following["pos"].alias("next_pos"), following["neg"].alias("next_neg"), "P", "N",
    )


def _share(count: str, total: str):
    return F.when(F.col(total) > 0, F.col(count) / F.col(total)).otherwise(F.lit(0.0))


def _known(label: str, classes: Column) -> Column:
    """The label, or an error if it is null or none of the classes."""
    text = F.concat(F.lit("label "), F.coalesce(F.col(label).cast("string"), F.lit("null")), F.lit(" is no known class"))
    return F.when(F.array_contains(classes, F.col(label)), F.col(label)).otherwise(F.raise_error(text).cast("int"))


def binary_points(pred: DataFrame, by: Sequence[str] = (), classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Score of the second class and 0/1 label. ``classes`` names the labels in the order of ``prob``."""
    true = _known("y_true", F.array(*map(F.lit, classes)))
    return pred.select(*by, F.get("prob", F.lit(1)).alias("score"), (true == classes[1]).cast("int").alias("positive"))


def ovr_points(pred: DataFrame, by: Sequence[str] = (), classes: Sequence[int] | None = None) -> DataFrame:
    """One row per row and class: the class, its probability, and whether it is the true one.

    ``classes`` names the labels in the order of ``prob``; without it they are 0..k-1.

    The outer form keeps the optimizer from testing the array for emptiness first, which would compute
    the probabilities twice; rows without probabilities are dropped afterwards.
    """
    names = F.sequence(F.lit(0), F.size("prob") - 1) if classes is None else F.array(*map(F.lit, classes))
    true = F.when(F.size("prob") > 0, _known("y_true", names))
    long = pred.select(*by, true.alias("y_true"), F.posexplode_outer("prob").alias("class", "score"))
    long = long.filter(F.col("class").isNotNull())
    if classes is not None:
        long = long.withColumn("class", F.get(names, F.col("class")))
    return long.select(*by, "class", "score", F.when(F.col("class") == F.col("y_true"), 1).otherwise(0).alias("positive"))


def roc_curve(points: DataFrame, by: Sequence[str] = (), drop_collinear: bool = True) -> DataFrame:
    """(by, threshold, fpr, tpr) in descending thresholds, starting with (infinity, 0, 0).

    With ``drop_collinear`` a point is left out when the next step continues in the same direction
    with the same counts; the first and last thresholds always stay.
    """
    by = list(by)
    ranked = ranked_counts(points, by)
    if drop_collinear:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        turn = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        ranked = ranked.filter(first | F.col("next_pos").isNull() | turn)
    curve = ranked.select(*by, F.col("score").alias("threshold"), _share("fp", "N").alias("fpr"), _share("tp", "P").alias("tpr"))
    start = points.select(*by).distinct() if by else points.limit(1).select()
    origin = start.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.unionByName(origin)


def pr_curve(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, precision, recall); the closing point (recall 0, precision 1) has no threshold."""
    by = list(by)
    ranked = ranked_counts(points, by)
    recall = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(1.0))
    curve = ranked.select(
        *by, F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        recall.alias("recall"),
    )
    start = points.select(*by).distinct() if by else points.limit(1).select()
    closing = start.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(closing)


def curve_areas(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: ROC-AUC (0 with one class only), average precision, trapezoid PR area, positives.

    All three are sums over the same ranked counts, so they share one pass.
    """
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    positives, negatives = F.max("P").cast("double"), F.max("N").cast("double")
    precision = tp / (tp + fp)
    before = F.when(tp + fp > pos + neg, F.try_divide(tp - pos, tp + fp - pos - neg)).otherwise(F.lit(1.0))
    return ranked_counts(points, by).groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(neg * (tp - pos / 2)), positives * negatives), F.lit(0.0)).alias("roc_auc"),
        F.coalesce(F.try_divide(F.sum(pos * precision), positives), F.lit(0.0)).alias("average_precision"),
        F.coalesce(F.try_divide(F.sum(pos * (precision + before) / 2), positives), F.lit(0.0)).alias("pr_auc_trapezoid"),
        F.max("P").alias("positives"),
    )


def roc_auc(pred: DataFrame, by: Sequence[str] = (), classes: Sequence[int] = (0, 1)) -> DataFrame:
    return curve_areas(binary_points(pred, by, classes), by).select(*by, "roc_auc")


def average_precision(pred: DataFrame, by: Sequence[str] = (), classes: Sequence[int] = (0, 1)) -> DataFrame:
    return curve_areas(binary_points(pred, by, classes), by).select(*by, "average_precision")


def pr_auc_trapezoid(pred: DataFrame, by: Sequence[str] = (), classes: Sequence[int] = (0, 1)) -> DataFrame:
    return curve_areas(binary_points(pred, by, classes), by).select(*by, "pr_auc_trapezoid")


def ovr_areas(pred: DataFrame, by: Sequence[str] = (), classes: Sequence[int] | None = None) -> DataFrame:
    """Per group and class: the areas of that class against the rest."""
    return curve_areas(ovr_points(pred, by, classes), [*by, "class"])


def weighted_ovr(areas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over the classes of ``ovr_areas``, weighted by the number of rows of each class."""
    total = F.sum("positives")
    return areas.groupBy(*by).agg(*[
        F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("positives")), total), F.lit(0.0)).alias(c)
        for c in ("roc_auc", "average_precision")
    ])


def micro_auc(pred: DataFrame, by: Sequence[str] = (), classes: Sequence[int] | None = None) -> DataFrame:
    """ROC-AUC and trapezoid PR area over all (row, class) cells together."""
    return curve_areas(ovr_points(pred, by, classes).drop("class"), by).select(*by, "roc_auc", "pr_auc_trapezoid")
