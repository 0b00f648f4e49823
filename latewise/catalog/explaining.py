"""Queries: explanations of a two-class softmax model with fixed weights, and of a fitted tree."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.catalog import sql as S
from latewise.catalog.modelling import FEATURES, FIVE_FEATURES, binary_splits, five_splits, parts, unscaled
from latewise.catalog.registry import query, r, rounded
from latewise.functions import argmax
from latewise.operators import explain as X
from latewise.operators.models import DecisionTree, registry
from latewise.operators.split import stratified_split
from latewise.operators.tree_shap import tree_shap
from latewise.plans.binary import materialize
from latewise.sources.order_items import order_items

NAMES = ["order_processing_days", "shipping_mode", "price", "discount", "quantity"]
# Weights of the explained model and its grid.
WEIGHTS = [0.1, -0.2, 0.3, -0.4, 0.5]
INTERCEPT = 0.1
BACKGROUND = 50
STEPS = 10

MODEL = X.SoftmaxModel(NAMES, np.array([[0.0] * 5, WEIGHTS]), np.array([0.0, INTERCEPT]))

_MARGIN = " + ".join(f"{w}::DOUBLE * {n}" for n, w in zip(NAMES, WEIGHTS)) + f" + {INTERCEPT}::DOUBLE"

_INPUT = f"""{S.ORDER_ITEMS}, {S.split("order_items", "late", "row_key")},
inputs AS (
  SELECT row_key, late AS y_true, split, processing_days::DOUBLE AS order_processing_days, days_for_shipment_scheduled::DOUBLE AS shipping_mode,
    product_price / 1000 AS price, discount_rate * 10 AS discount, quantity / 50 AS quantity FROM split_rows),
margins AS (SELECT *, {_MARGIN} AS m FROM inputs),
pred AS (SELECT row_key, y_true, CASE WHEN m > 0 THEN 1 ELSE 0 END AS y_pred FROM margins),
background AS (SELECT *, row_number() OVER (ORDER BY row_key) AS bg FROM (SELECT * FROM margins WHERE split = 'train' ORDER BY row_key LIMIT {BACKGROUND})),
bases AS (SELECT 1 AS class, avg(1 / (1 + exp(-m))) AS base FROM background UNION ALL SELECT 0, avg(1 / (1 + exp(m))) FROM background)"""

_SLOPES = f"""{_INPUT},
slopes AS (
  SELECT row_key, bg, avg(s * (1 - s)) AS g FROM (
    SELECT x.row_key, b.bg, 1 / (1 + exp(-((k + 0.5::DOUBLE) / {STEPS} * x.m + (1 - (k + 0.5::DOUBLE) / {STEPS}) * b.m))) AS s
    FROM margins x, background b, range({STEPS}) t(k)) GROUP BY 1, 2),
contributions AS (
  SELECT x.row_key, {", ".join(f"avg((x.{n} - b.{n}) * g) * {w}::DOUBLE AS {n}" for n, w in zip(NAMES, WEIGHTS))}
  FROM slopes JOIN margins x USING (row_key) JOIN background b USING (bg) GROUP BY 1),
explained AS (
  SELECT c.row_key, class, base, feature, CASE class WHEN 1 THEN shap ELSE -shap END AS shap
  FROM (UNPIVOT contributions ON {", ".join(NAMES)} INTO NAME feature VALUE shap) c, bases)"""

_LINEAR = f"""{_INPUT},
means AS (SELECT {", ".join(f"avg({n}) AS {n}" for n in NAMES)}, avg(m) AS base FROM margins WHERE split = 'train'),
explained AS (
  SELECT row_key, base, feature, shap FROM (
    UNPIVOT (SELECT x.row_key, base, {", ".join(f"{w}::DOUBLE * (x.{n} - means.{n}) AS {n}" for n, w in zip(NAMES, WEIGHTS))} FROM margins x, means)
    ON {", ".join(NAMES)} INTO NAME feature VALUE shap))"""


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines with the five features of the explained model, label and split."""
    rows = order_items(
        spark, sf_dir, "row_key", "late", "processing_days", "days_for_shipment_scheduled", "product_price", "discount_rate", "quantity"
    )
    rows = stratified_split(materialize(rows, "lines"), "late", "row_key")
    return rows.select(
        "row_key", F.col("late").alias("y_true"), "split", F.col("processing_days").cast("double").alias("order_processing_days"),
        F.col("days_for_shipment_scheduled").cast("double").alias("shipping_mode"), (F.col("product_price") / 1000).alias("price"),
        (F.col("discount_rate") * 10).alias("discount"), (F.col("quantity") / 50).alias("quantity"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """The rows with the model's prediction beside the label."""
    return rows.withColumn("prob", MODEL.probability()).withColumn("y_pred", argmax(F.col("prob"))).drop("prob")


def predictions(rows: DataFrame) -> DataFrame:
    scored = rows.select("row_key", "y_true", MODEL.probability().alias("prob"))
    return scored.withColumn("y_pred", argmax(F.col("prob")))


def gradients(rows: DataFrame, keep: tuple[str, ...] = ()) -> X.Explanations:
    background = X.background_sample(rows.filter(F.col("split") == "train"), "row_key", NAMES, BACKGROUND)
    return X.expected_gradients(rows, background, MODEL, steps=STEPS, keep=keep)


@query("shap_expected_gradients", f"""WITH {_SLOPES}
SELECT row_key, class, round(base, 6) AS base, {", ".join(f"round(max(CASE feature WHEN '{n}' THEN shap END), 6) + 0.0 AS {n}" for n in NAMES)}
FROM explained GROUP BY 1, 2, 3""")
def shap_expected_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions to both class probabilities of every order line."""
    table = gradients(inputs(spark, sf_dir)).table
    return table.select("row_key", "class", r("base").alias("base"), *[r(F.get("shap", F.lit(i))).alias(n) for i, n in enumerate(NAMES)])


@query("shap_linear", f"""WITH {_LINEAR}
SELECT row_key, round(base, 6) AS base, {", ".join(f"round(max(CASE feature WHEN '{n}' THEN shap END), 6) + 0.0 AS {n}" for n in NAMES)}
FROM explained GROUP BY 1, 2""")
def shap_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = linear(inputs(spark, sf_dir)).table
    return table.select("row_key", r("base").alias("base"), *[r(F.get("shap", F.lit(i))).alias(n) for i, n in enumerate(NAMES)])


def linear(rows: DataFrame, keep: tuple[str, ...] = ()) -> X.Explanations:
    """Linear contributions against the means of the training rows."""
    return X.linear_shap(rows, rows.filter(F.col("split") == "train"), NAMES, WEIGHTS, INTERCEPT, keep=keep)


@query("shap_base", f"""WITH {_INPUT}
SELECT 1 AS class, round(avg(1 / (1 + exp(-m))), 6) AS base FROM margins WHERE split = 'train'
UNION ALL SELECT 0, round(avg(1 / (1 + exp(m))), 6) FROM margins WHERE split = 'train'""")
def shap_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability per class over all training rows."""
    rows = inputs(spark, sf_dir)
    return rounded(X.base_value(predictions(rows.filter(F.col("split") == "train"))), ["base"])


@query("shap_summary", f"""WITH {_SLOPES}, v AS (UNPIVOT (SELECT row_key, {", ".join(NAMES)} FROM margins) ON {", ".join(NAMES)} INTO NAME feature VALUE value),
s AS (SELECT class, feature, count(*) AS n, avg(abs(shap)) AS importance, avg(shap) AS mean_shap, avg(value) AS mean_value
  FROM explained JOIN v USING (row_key, feature) GROUP BY 1, 2)
SELECT class, feature, n, round(importance, 6) AS importance, round(mean_shap, 6) + 0.0 AS mean_shap, round(mean_value, 6) AS mean_value,
  CAST(row_number() OVER (PARTITION BY class ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM s""")
def shap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.shap_summary(gradients(inputs(spark, sf_dir))), ["importance", "mean_shap", "mean_value"])


@query("shap_dependence", f"""WITH {_SLOPES}
SELECT row_key, class, order_processing_days AS value, round(shap, 6) + 0.0 AS shap, shipping_mode AS interaction
FROM explained JOIN margins USING (row_key) WHERE feature = 'order_processing_days'""")
def shap_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing days against their contribution, by shipping mode."""
    table = X.shap_dependence(gradients(inputs(spark, sf_dir)), "order_processing_days", "shipping_mode")
    return rounded(table, ["shap"])


@query("shap_decision", f"""WITH {_LINEAR},
importance AS (SELECT feature, row_number() OVER (ORDER BY avg(abs(shap)), feature DESC) AS step FROM explained GROUP BY 1)
SELECT row_key, CAST(step AS INTEGER) AS step, feature, CASE WHEN y_true <> y_pred THEN 1 ELSE 0 END AS highlight,
  round(base + sum(shap) OVER (PARTITION BY row_key ORDER BY step ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS output
FROM explained JOIN importance USING (feature) JOIN pred USING (row_key)""")
def shap_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained = linear(judged(inputs(spark, sf_dir)), keep=("y_true", "y_pred"))
    return rounded(X.shap_decision(explained).drop("class"), ["output"], 9)


_BARS = """bars AS (
  SELECT e.*, y_true, y_pred, row_number() OVER (PARTITION BY row_key ORDER BY abs(shap) DESC, feature) AS rank FROM explained e
  JOIN pred USING (row_key) WHERE class = y_pred)"""


@query("shap_waterfall", f"""WITH {_SLOPES}, {_BARS}
SELECT row_key, class, CAST(rank AS INTEGER) AS place, feature, round(base, 6) AS base, round(shap, 6) + 0.0 AS shap FROM bars WHERE rank <= 2
UNION ALL SELECT row_key, class, 3, '3 other features', round(base, 6), round(sum(shap), 6) + 0.0 FROM bars WHERE rank > 2 GROUP BY row_key, class, base""")
def shap_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest contributions to the predicted class of every row, and the rest."""
    explained = gradients(judged(inputs(spark, sf_dir)), keep=("y_pred",)).predicted_only()
    return rounded(X.shap_waterfall(explained, max_display=3), ["base", "shap"])


@query("shap_force", f"""WITH {_SLOPES}
SELECT row_key, class, round(base, 6) AS base, round(sum(CASE WHEN shap > 0 THEN shap ELSE 0 END), 6) + 0.0 AS positive,
  round(sum(CASE WHEN shap < 0 THEN shap ELSE 0 END), 6) + 0.0 AS negative, round(base + sum(shap), 6) + 0.0 AS output
FROM explained GROUP BY row_key, class, base""")
def shap_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.shap_force(gradients(inputs(spark, sf_dir))), ["base", "positive", "negative", "output"])


@query("error_cases", f"""WITH {_SLOPES}, {_BARS}, wrong AS (SELECT row_key FROM pred WHERE y_true <> y_pred ORDER BY row_key LIMIT 3)
SELECT row_key, y_true, y_pred, CAST(rank AS INTEGER) AS place, feature, round(shap, 6) + 0.0 AS shap
FROM bars WHERE row_key IN (SELECT row_key FROM wrong)""")
def error_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three misclassified rows with the contributions to the class they were given."""
    rows = inputs(spark, sf_dir)
    background = X.background_sample(rows.filter(F.col("split") == "train"), "row_key", NAMES, BACKGROUND)
    table = X.error_cases(judged(rows), lambda few: X.expected_gradients(few, background, MODEL, steps=STEPS))
    return rounded(table.select("row_key", "y_true", "y_pred", "place", "feature", "shap"), ["shap"])


@query("misclassified_rows", f"WITH {S.BINARY} SELECT row_key, y_true, y_pred FROM pred WHERE y_true <> y_pred")
def misclassified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latewise.operators.clean import misclassified
    from latewise.sources.order_items import binary_predictions

    return misclassified(binary_predictions(spark, sf_dir)).drop("prob")


def _fitted_softmax(table: DataFrame, label: str, features: list[str], steps: int) -> DataFrame:
    """Summary of the expected gradients of a logistic regression fitted on the training rows, for all test rows; ``off`` is
    how far contributions and base together stay from the probability at most (the error of the grid)."""
    split = parts(table, label, features)
    fitted = registry(split["train"].count(), 2)["LogisticRegression"].fit(split["train"])
    model = X.SoftmaxModel.from_logistic(fitted, features)
    background = X.background_sample(table.filter(F.col("split") == "train"), "row_key", features, BACKGROUND)
    test = table.filter(F.col("split") == "test").withColumn("probability", model.probability())
    explained = X.expected_gradients(test, background, model, steps=steps, keep=("probability",))
    explained = X.Explanations(materialize(explained.table, "explained"), explained.features, explained.key)
    total = F.aggregate("shap", F.col("base"), lambda s, v: s + v)
    off = explained.table.groupBy("class").agg(F.max(F.abs(total - F.get("probability", F.col("class")))).alias("off"))
    return rounded(X.shap_summary(explained).join(off, "class"), ["importance", "mean_shap", "mean_value", "off"], 4)


@query("shap_fitted")
def shap_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions to both probabilities of a fitted logistic regression, all test rows."""
    return _fitted_softmax(binary_splits(spark, sf_dir), "late", FEATURES, 50)


@query("shap_five_class")
def shap_five_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the five-class model."""
    return _fitted_softmax(five_splits(spark, sf_dir), "stability", FIVE_FEATURES, 20)


@query("shap_tree")
def shap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact contributions of a fitted tree on all test rows against all training rows, by class and feature, and how far
    contributions and base together stay from the predicted probability at most."""
    split = unscaled(spark, sf_dir, "late", FEATURES)
    model = DecisionTree(max_depth=5).fit(split["train"])
    cols = [vector_to_array("features")[i].alias(c) for i, c in enumerate(FEATURES)]
    train, test = (split[p].select("row_key", "features", *cols) for p in ("train", "test"))
    explained = tree_shap(model, model.transform(test), train, FEATURES, keep=("probability",))
    explained = X.Explanations(materialize(explained.table, "explained"), explained.features, explained.key)
    total = F.aggregate("shap", F.col("base"), lambda s, v: s + v)
    off = explained.table.groupBy("class").agg(F.max(F.abs(total - F.get("probability", F.col("class")))).alias("off"))
    return rounded(X.shap_summary(explained).join(off, "class"), ["importance", "mean_shap", "mean_value", "off"])


@query("shap_permutation")
def shap_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute contribution per class and feature of a fitted tree, over all test rows."""
    table = binary_splits(spark, sf_dir)
    split = parts(table, "late", FEATURES)
    model = DecisionTreeClassifier(maxDepth=5, seed=42).fit(split["train"])
    background = X.background_sample(table.filter(F.col("split") == "train"), "row_key", FEATURES, 20)
    explained = X.permutation_shap(model, table.filter(F.col("split") == "test"), background, FEATURES)
    return rounded(X.shap_summary(explained), ["importance", "mean_shap", "mean_value"])
