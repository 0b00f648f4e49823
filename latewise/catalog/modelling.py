"""Queries: prepared tables, models, experiments, persistence."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.ml.classification import NaiveBayes
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.catalog import sql as S
from latewise.catalog.evaluation import _FIVE, _RECORD, record_sql
from latewise.catalog.registry import query, r, rounded
from latewise.catalog.stats import feature_means
from latewise.catalog.tables import stability_parts
from latewise.operators import metrics, results
from latewise.operators.features import LABEL
from latewise.operators.losses import cross_entropy
from latewise.operators.models import (
    DecisionTree, GradientBoosting, NearestNeighbours, feature_importance, fit_mlp, registry, score,
)
from latewise.operators.scale import Standardizer
from latewise.operators.split import stratified_split
from latewise.plans.binary import data_quality as quality_report
from latewise.plans.binary import engineered_table, materialize, prepare_binary
from latewise.plans.experiment import run_ablation, run_models, run_study
from latewise.plans.five_class import prepare_five_class
from latewise.session import work_dir
from latewise.sources.order_items import binary_predictions, load, multi_predictions, order_items
from latewise.sources.tables import (
    load_model, load_params, read_table, save_model, save_params, stamped, to_xy, write_report, write_results,
)

_ENC = ["category_name", "customer_segment", "department_name", "market", "order_status", "shipping_mode", "customer_country", "product_name"]
_KM = """CASE WHEN s <= 0 THEN 0 ELSE 6378.137::DOUBLE * (s - 1 / 298.257223563::DOUBLE / 2 * (
      (s - sin(s)) * pow(sin(p) * cos(q), 2) / pow(cos(s / 2), 2)
      + (s + sin(s)) * pow(cos(p) * sin(q), 2) / pow(sin(s / 2), 2))) END"""

ENGINEERED = f"""{S.ORDER_ITEMS},
reduced AS (
  SELECT *, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(latitude_src))) AS b1,
    atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(latitude_dest))) AS b2 FROM order_items),
angles AS (
  SELECT *, 2 * asin(sqrt(least(1, pow(sin((b2 - b1) / 2), 2)
    + cos(b1) * cos(b2) * pow(sin(radians(longitude_dest - longitude_src) / 2), 2)))) AS s, (b1 + b2) / 2 AS p, (b2 - b1) / 2 AS q FROM reduced),
n_items AS (SELECT order_id, count(DISTINCT order_item_cardprod_id) AS order_num_distinct_items FROM order_items GROUP BY 1),
engineered AS (
  SELECT row_key, order_item_cardprod_id, order_item_product_price, product_price, order_item_discount, order_profit_per_order,
    latitude_src, longitude_src, latitude_dest, longitude_dest, {", ".join(_ENC)}, type, delivery_status,
    processing_days AS order_processing_days,
    CASE WHEN processing_days <= -1 THEN NULL WHEN processing_days <= 0 THEN '0_days' WHEN processing_days <= 2 THEN '1_2_days'
      WHEN processing_days <= 4 THEN '3_4_days' WHEN processing_days <= 6 THEN '5_6_days' ELSE '7_plus_days' END AS order_processing_days_binned,
    month(order_date) AS order_month, quarter(order_date) AS order_quarter, isodow(order_date) - 1 AS order_weekday,
    CASE WHEN isodow(order_date) >= 6 THEN 1 ELSE 0 END AS is_weekend_order, late AS delivery_risk, 1 - late AS on_time_delivery,
    CASE WHEN order_item_product_price > 0 THEN order_item_discount / order_item_product_price ELSE 0 END AS discount_percentage,
    order_item_product_price - order_item_discount AS actual_payment,
    CASE WHEN order_item_product_price - order_item_discount > 0
      THEN order_profit_per_order / (order_item_product_price - order_item_discount) ELSE 0 END AS profit_margin,
    {_KM} AS haversine_distance,
    CASE WHEN product_price <= 0 THEN NULL WHEN product_price <= 50 THEN 'Very_Low' WHEN product_price <= 100 THEN 'Low'
      WHEN product_price <= 200 THEN 'Medium' WHEN product_price <= 500 THEN 'High' ELSE 'Very_High' END AS price_range,
    order_num_distinct_items, 0 AS is_shipping_date_holiday
  FROM angles JOIN n_items USING (order_id))"""

_NUM = [
    "order_item_cardprod_id", "order_item_product_price", "product_price", "order_item_discount", "order_profit_per_order",
    "latitude_src", "longitude_src", "latitude_dest", "longitude_dest",
]
_NUM_LATER = [
    "order_processing_days", "order_month", "order_quarter", "order_weekday", "discount_percentage", "actual_payment",
    "profit_margin", "haversine_distance", "order_num_distinct_items", "is_shipping_date_holiday",
]
_LEVELS = {
    "type": ["A", "N", "R"], "delivery_status": ["F", "O"], "on_time_delivery": ["0", "1"], "is_weekend_order": ["0", "1"],
    "price_range": ["High", "Low", "Medium", "Very_High", "Very_Low"],
    "order_processing_days_binned": ["0_days", "1_2_days", "3_4_days", "5_6_days", "7_plus_days"],
}
_WIDE = [
    *[f"CAST({c} AS DOUBLE) AS {c}" for c in _NUM],
    *[f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}" for c in _ENC],
    *[f"CAST({c} AS DOUBLE) AS {c}" for c in _NUM_LATER],
    *[f"CASE WHEN CAST({c} AS VARCHAR) = '{v}' THEN 1::DOUBLE ELSE 0 END AS \"{c}_{v}\"" for c, vs in _LEVELS.items() for v in vs],
    *[f"CASE WHEN {c} IS NULL THEN 1::DOUBLE ELSE 0 END AS {c}_nan" for c in _LEVELS],
]

_PREPARED = f"""WITH {ENGINEERED}, {S.split("engineered", "delivery_risk", "row_key")},
wide AS (SELECT row_key, delivery_risk, split, {", ".join(_WIDE)} FROM split_rows),
long AS (UNPIVOT wide ON COLUMNS(* EXCLUDE (row_key, delivery_risk, split)) INTO NAME feature VALUE x),
stats AS (SELECT feature, delivery_risk, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1, 2),
centre AS (SELECT feature, sum(n * m) / sum(n) AS c FROM stats GROUP BY 1),
scores AS (
  SELECT feature, sum(n * pow(m - c, 2)) AS between_ss, sum(n * v) AS within_ss, sum(n) AS n FROM stats JOIN centre USING (feature) GROUP BY 1),
best AS (
  SELECT feature FROM scores WHERE (between_ss + within_ss) / n > 0.01
  ORDER BY CASE WHEN within_ss = 0 THEN 'Infinity'::DOUBLE ELSE between_ss / within_ss END DESC LIMIT 50),
fitted AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS std FROM long WHERE split = 'train' GROUP BY 1)
SELECT split, delivery_risk, feature, count(*) AS n, round(avg((x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END), 5) + 0.0 AS mean
FROM long JOIN best USING (feature) JOIN fitted USING (feature) GROUP BY 1, 2, 3"""


@query("prepare_binary", _PREPARED)
def binary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines cleaned, encoded, selected, split and scaled; mean per split, label and feature."""
    table = prepare_binary(order_items(spark, sf_dir, customers_first=True)).table
    return feature_means(table, "split", "delivery_risk", digits=5)


_FIVE_COLS = ["discount_rate", "tax", "quantity", "line_number", "supplier_id", "order_item_product_price"]


@query("prepare_five_class", f"""
WITH {S.ORDER_ITEMS}, merged AS (
  SELECT DISTINCT {", ".join(_FIVE_COLS)}, CAST(stability AS BIGINT) AS stability, row_key FROM order_items),
{S.split("merged", "stability", "row_key")},
long AS (UNPIVOT (SELECT row_key, stability, split, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FIVE_COLS)} FROM split_rows)
  ON COLUMNS(* EXCLUDE (row_key, stability, split)) INTO NAME feature VALUE x),
fitted AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS std FROM long WHERE split = 'train' GROUP BY 1)
SELECT split, stability, feature, count(*) AS n, round(avg((x - mean) / std), 5) + 0.0 AS mean FROM long JOIN fitted USING (feature) GROUP BY 1, 2, 3""")
def five_class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping tables with holes merged, filled, split and scaled; mean per split, label and feature."""
    a, b = stability_parts(spark, sf_dir)
    table = prepare_five_class(a, b, "stability", key="row_key").table
    return feature_means(table, "split", "stability", digits=5)


_HOLED = {"discount_rate": "nullif(discount_rate, 0)", "tax": "nullif(tax, 0)"}
_OWN = [
    "discount_rate", "tax", "quantity", "line_number", "supplier_id", "order_item_product_price", "stability",
]
_CONTENT = ", ".join(f"coalesce('=' || {c}, '~')" for c in _OWN)


@query("five_class_without_key", f"""
WITH {S.ORDER_ITEMS}, merged AS (SELECT DISTINCT {", ".join(f"{_HOLED.get(c, c)} AS {c}" for c in _OWN)} FROM order_items),
keyed AS (
  SELECT * REPLACE (coalesce(discount_rate, 0) AS discount_rate, coalesce(tax, 0) AS tax, CAST(stability AS BIGINT) AS stability),
    md5(concat_ws('|', {_CONTENT})) || '-1' AS own_key FROM merged),
{S.split("keyed", "stability", "own_key")},
long AS (UNPIVOT (SELECT own_key, stability, split, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FIVE_COLS)} FROM split_rows)
  ON COLUMNS(* EXCLUDE (own_key, stability, split)) INTO NAME feature VALUE x),
fitted AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS std FROM long WHERE split = 'train' GROUP BY 1)
SELECT split, stability, feature, count(*) AS n, round(avg((x - mean) / std), 5) + 0.0 AS mean FROM long JOIN fitted USING (feature) GROUP BY 1, 2, 3""")
def five_class_without_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables without their key column: the rows' content before filling is the key."""
    a, b = (part.drop("row_key") for part in stability_parts(spark, sf_dir))
    return feature_means(prepare_five_class(a, b, "stability").table, "split", "stability", digits=5)


_QUALITY_F = [*_NUM, *_NUM_LATER[:-1], "is_weekend_order", "on_time_delivery"]


@query("data_quality", f"""
WITH RECURSIVE {ENGINEERED},
long AS (UNPIVOT (SELECT delivery_risk, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _QUALITY_F)} FROM engineered)
  ON COLUMNS(* EXCLUDE (delivery_risk)) INTO NAME feature VALUE x),
stats AS (SELECT feature, delivery_risk, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1, 2),
centre AS (SELECT feature, sum(n * m) / sum(n) AS c FROM stats GROUP BY 1),
scores AS (
  SELECT feature, sum(n * pow(m - c, 2)) AS between_ss, sum(n * v) AS within_ss, sum(n) AS n, count(*) AS k FROM stats JOIN centre USING (feature) GROUP BY 1),
tested_f AS (
  SELECT feature, n, k, CASE WHEN within_ss = 0 THEN 'Infinity'::DOUBLE ELSE between_ss * (n - k) / (within_ss * (k - 1)) END AS f FROM scores),
{S.f_tails("tested_f")}
SELECT 'shape' AS section, 'rows' AS item, count(*)::DOUBLE AS value FROM engineered
UNION ALL SELECT 'shape', 'columns', count(*)::DOUBLE FROM (DESCRIBE engineered)
UNION ALL SELECT 'missing', 'order_processing_days_binned', count(*)::DOUBLE FROM engineered WHERE order_processing_days_binned IS NULL
UNION ALL SELECT 'class_rows', CAST(delivery_risk AS VARCHAR), count(*)::DOUBLE FROM engineered GROUP BY 2
UNION ALL SELECT 'class_share', CAST(delivery_risk AS VARCHAR), round(count(*) / (SELECT count(*) FROM engineered)::DOUBLE, 4) FROM engineered GROUP BY 2
UNION ALL SELECT 'f_score', feature, round(f, 4) FROM tested_f
UNION ALL SELECT 'validity', 'effective', count(*) FILTER (p < 0.05)::DOUBLE FROM tails
UNION ALL SELECT 'validity', 'weak', count(*) FILTER (p > 0.01)::DOUBLE FROM tails""")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality_report(engineered_table(order_items(spark, sf_dir, customers_first=True), "engineered")), ["value"], 4)


# Columns that restate the label: what they are encoded to is left out of the study's models.
LEAKING = ("on_time_delivery_0", "on_time_delivery_1", "on_time_delivery_nan")

FEATURES = [
    "processing_days", "days_for_shipment_scheduled", "order_item_product_price", "order_item_discount",
    "order_profit_per_order", "latitude_src", "longitude_src", "latitude_dest", "longitude_dest", "quantity", "tax",
]


def binary_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with scaled numeric columns, the late label and a split column."""
    lines = materialize(order_items(spark, sf_dir, "row_key", *FEATURES, "late"), "lines")
    rows = stratified_split(lines, "late", "row_key")
    rows = rows.withColumns({c: F.col(c).cast("double") for c in FEATURES})
    table = Standardizer.fit(rows.filter(F.col("split") == "train"), FEATURES).apply(rows)
    return materialize(table, "binary-splits")


FIVE_FEATURES = ["quantity", "line_number", "processing_days", "tax", "discount_rate"]


def five_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = materialize(order_items(spark, sf_dir, "row_key", *FIVE_FEATURES, "stability"), "lines")
    rows = stratified_split(lines, "stability", "row_key")
    rows = rows.withColumns({c: F.col(c).cast("double") for c in FIVE_FEATURES})
    table = Standardizer.fit(rows.filter(F.col("split") == "train"), FIVE_FEATURES).apply(rows)
    return materialize(table, "five-splits")


def parts(table: DataFrame, label: str, features: list[str]) -> dict[str, DataFrame]:
    return {p: to_xy(table.filter(F.col("split") == p), label, features, keep=["row_key"]) for p in ("train", "val", "test")}


def _model_metrics(name: str, five: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    if five:
        split = parts(five_splits(spark, sf_dir), "stability", FIVE_FEATURES)
    else:
        split = parts(binary_splits(spark, sf_dir), "late", FEATURES)
    n_train = split["train"].count()
    models = registry(n_train, 5 if five else 2)
    return run_models(models, split["train"], split["test"], 5 if five else 2, [name], ("row_key",), "raise")


for _key, _model in (
    ("model_gbt", "boosted_trees"), ("model_gbt_fine", "boosted_trees_fine"), ("model_rf", "RandomForest"),
    ("model_lr", "LogisticRegression"), ("model_extratrees", "ExtraTrees"), ("model_knn", "KNN"), ("model_nb", "NaiveBayes"),
):
    query(_key)(partial(_model_metrics, _model, False))
for _key, _model in (
    ("model_gbt_five", "boosted_trees"), ("model_rf_five", "RandomForest"), ("model_lr_five", "LogisticRegression"),
    ("model_extratrees_five", "ExtraTrees"), ("model_nb_five", "NaiveBayes"),
):
    query(_key)(partial(_model_metrics, _model, True))


def unscaled(spark: SparkSession, sf_dir: str, label: str, features: list[str]) -> dict[str, DataFrame]:
    """Split rows as they are: a tree's cuts do not depend on scaling. The lines are written once; the split is a projection."""
    lines = materialize(order_items(spark, sf_dir, "row_key", *features, label, customers_first=True), "lines", "zstd")
    return parts(stratified_split(lines, label, "row_key"), label, features)


_LATE_ROWS = f"{S.ORDER_ITEMS}, {S.split('order_items', 'late', 'row_key')}"
_FIVE_ROWS = f"{S.ORDER_ITEMS}, {S.split('order_items', 'stability', 'row_key')}"
_LATE_TREE = f"{_LATE_ROWS}, {S.tree('t', FEATURES, 'late', 2)}"
_RECORDED = f"""model, n, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _RECORD)}, confusion_matrix"""


def _tree_record(label: str, features: list[str], n_classes: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    split = unscaled(spark, sf_dir, label, features)
    models = {"DecisionTree": DecisionTree(max_depth=5)}
    records = run_models(models, split["train"], split["test"], n_classes, on_error="raise")
    return rounded(records.select("model", "n", *_RECORD, "confusion_matrix"), _RECORD)


query("model_dt", f"""WITH {_LATE_TREE}, scored AS (SELECT 'DecisionTree' AS model, y_true, y_pred, p1 AS score, y_true AS positive FROM t_pred), """
      + record_sql("scored", "model,", "scored", "model,", "final AS (SELECT model, roc_auc, average_precision AS pr_auc FROM areas)")
      + f" SELECT {_RECORDED} FROM record")(partial(_tree_record, "late", FEATURES, 2))
query("model_dt_five", f"""WITH {_FIVE_ROWS}, {S.tree("t", FIVE_FEATURES, "stability", 5)},
scored AS (SELECT 'DecisionTree' AS model, * FROM t_pred),
cells AS ({" UNION ALL ".join(f"SELECT model, {c} AS class, p{c} AS score, CASE WHEN y_true = {c} THEN 1 ELSE 0 END AS positive FROM scored" for c in range(5))}), """
      + record_sql("scored", "model,", "cells", "model, class,",
                   "final AS (SELECT model, sum(roc_auc * positives) / sum(positives) AS roc_auc, "
                   "sum(average_precision * positives) / sum(positives) AS pr_auc FROM areas GROUP BY 1)")
      + f" SELECT {_RECORDED} FROM record")(partial(_tree_record, "stability", FIVE_FEATURES, 5))


_ROUND = ["quantity", "line_number", "processing_days", "days_for_shipment_scheduled", "tax", "discount_rate"]


@query("boosting_round", f"""WITH {_LATE_ROWS},
long AS (SELECT late AS y, list_position([{", ".join(f"'{c}'" for c in _ROUND)}], feature) AS j, feature, v FROM (
  UNPIVOT (SELECT late, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _ROUND)} FROM split_rows WHERE split = 'train')
  ON COLUMNS(* EXCLUDE (late)) INTO NAME feature VALUE v)),
per_value AS (SELECT j, feature, v, count(*) AS n, sum(0.5::DOUBLE - y) AS g, sum(0.25::DOUBLE) AS h FROM long GROUP BY 1, 2, 3),
runs AS (
  SELECT j, feature, v, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER p AS n, sum(g) OVER p AS g, sum(h) OVER p AS h
  FROM per_value WINDOW p AS (PARTITION BY j), w AS (PARTITION BY j ORDER BY v ROWS UNBOUNDED PRECEDING)),
best AS (
  SELECT * FROM runs WHERE nl < n ORDER BY gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) DESC, j, v LIMIT 1)
SELECT 'left' AS side, feature, v AS threshold, CAST(nl AS BIGINT) AS n, round(gl, 6) AS grad, round(hl, 6) AS hess,
  round(-0.1 * gl / (hl + 1), 6) + 0.0 AS value FROM best
UNION ALL SELECT 'right', feature, v, CAST(n - nl AS BIGINT), round(g - gl, 6), round(h - hl, 6), round(-0.1 * (g - gl) / (h - hl + 1), 6) + 0.0 FROM best""")
def boosting_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round of boosting with one cut: both leaves with their gradient, Hessian and value."""
    train = unscaled(spark, sf_dir, "late", _ROUND)["train"]
    model = GradientBoosting(n_trees=1, max_depth=1, learning_rate=0.1, row_share=1.0, column_share=1.0).fit(train)
    tree = model.trees[0][0]
    cut = model.edges[tree.feature[0]][tree.bin[0]]
    rows = [
        (side, _ROUND[tree.feature[0]], float(cut), int(tree.rows[i]), float(tree.grad[i]), float(tree.hess[i]), float(tree.value[i]))
        for side, i in (("left", 1), ("right", 2))
    ]
    leaves = spark.createDataFrame(rows, "side string, feature string, threshold double, n long, grad double, hess double, value double")
    return rounded(leaves, ["grad", "hess", "value"])


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").withColumn("vec_key", F.col("vec_id").cast("string"))
    return stratified_split(rows, "label", "vec_key")


_VECTORS = f"""vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label, CAST(vec_id AS VARCHAR) AS vec_key FROM embeddings),
{S.split("vectors", "label", "vec_key")}"""


@query("knn_predict", f"""
WITH {_VECTORS}, pairs AS (
  SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, t.x), t.vec_id) AS rank
  FROM split_rows q JOIN split_rows t ON q.split = 'test' AND t.split = 'train'),
votes AS (SELECT vec_id, label, count(*) AS n FROM pairs WHERE rank <= 10 GROUP BY 1, 2),
winner AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS place FROM votes)
SELECT vec_id, label AS y_pred, n / 10::DOUBLE AS share FROM winner WHERE place = 1""")
def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest training vectors of every test vector vote on its label."""
    rows = _vectors(spark, sf_dir)
    model = NearestNeighbours(key="vec_id", features="embedding").fit(rows.filter(F.col("split") == "train"))
    pred = model.predict(rows.filter(F.col("split") == "test"))
    return pred.select("vec_id", "y_pred", F.array_max("prob").alias("share"))


@query("gaussian_nb", f"""
WITH {_VECTORS}, long AS (
  SELECT vec_id, label, split, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM split_rows),
fitted AS (SELECT label AS class, j, avg(v) AS m, var_pop(v) AS s FROM long WHERE split = 'train' GROUP BY 1, 2),
spread AS (SELECT max(s) * 1e-9 AS eps FROM (SELECT j, var_pop(v) AS s FROM long WHERE split = 'train' GROUP BY 1)),
prior AS (SELECT label AS class, ln(count(*) / (SELECT count(*) FROM split_rows WHERE split = 'train')::DOUBLE) AS lp
  FROM split_rows WHERE split = 'train' GROUP BY 1),
likelihood AS (
  SELECT vec_id, class, sum(-0.5::DOUBLE * ln(2 * pi() * (s + eps)) - pow(v - m, 2) / (2 * (s + eps))) AS ll
  FROM long JOIN fitted USING (j), spread WHERE split = 'test' GROUP BY 1, 2),
joint AS (SELECT vec_id, class, ll + lp AS jl FROM likelihood JOIN prior USING (class)),
scaled AS (SELECT *, jl - max(jl) OVER (PARTITION BY vec_id) AS d FROM joint),
prob AS (SELECT *, exp(d) / sum(exp(d)) OVER (PARTITION BY vec_id) AS p,
  row_number() OVER (PARTITION BY vec_id ORDER BY jl DESC, class) AS place FROM scaled)
SELECT vec_id, class AS y_pred, round(p, 5) AS p FROM prob WHERE place = 1""")
def gaussian_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    as_vector = [F.col("embedding")[i].cast("double").alias(f"x{i:02d}") for i in range(64)]
    table = rows.select("vec_id", "split", "label", *as_vector)
    cols = [f"x{i:02d}" for i in range(64)]
    train, test = (to_xy(table.filter(F.col("split") == p), "label", cols, keep=["vec_id"]) for p in ("train", "test"))
    pred = score(NaiveBayes(modelType="gaussian").fit(train), test, keep=("vec_id",))
    return pred.select("vec_id", "y_pred", r(F.array_max("prob"), 5).alias("p"))


@query("importance_top")
def importance_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most important columns of a forest on the training rows."""
    table = binary_splits(spark, sf_dir).filter(F.col("split") == "train")
    return feature_importance(table, FEATURES, "late")


def _mlp_record(split: dict[str, DataFrame], n_features: int, n_classes: int) -> DataFrame:
    """Metrics and loss on the test rows, rounds and least validation loss of the training."""
    model, history = fit_mlp(split["train"], split["val"], n_features, n_classes)
    pred = materialize(score(model, split["test"]), "scored")
    trained = history.agg(F.count("*").cast("int").alias("rounds"), F.min("val_loss").alias("least_val_loss"))
    record = results.metrics_record(pred, n_classes).crossJoin(cross_entropy(pred).select(F.col("log_loss").alias("test_loss")))
    return rounded(record.crossJoin(trained), [*_RECORD, "test_loss", "least_val_loss"])


@query("model_mlp")
def model_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptron in at most 100 rounds; 30 rounds without a better validation macro F1 end the training."""
    return _mlp_record(parts(binary_splits(spark, sf_dir), "late", FEATURES), len(FEATURES), 2)


@query("model_mlp_five")
def model_mlp_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for five classes."""
    return _mlp_record(parts(five_splits(spark, sf_dir), "stability", FIVE_FEATURES), len(FIVE_FEATURES), 5)


@query("score_split", f"WITH {_LATE_TREE} SELECT row_key, y_true, y_pred, round(p1, 6) + 0.0 AS p_late FROM t_pred")
def score_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with true and predicted class and the probability of being late."""
    split = unscaled(spark, sf_dir, "late", FEATURES)
    pred = score(DecisionTree(max_depth=5).fit(split["train"]), split["test"], keep=("row_key",))
    return pred.select("row_key", "y_true", "y_pred", r(F.col("prob")[1]).alias("p_late"))


@query("run_models")
def run_some_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the models by name on the same split."""
    split = parts(binary_splits(spark, sf_dir), "late", FEATURES)
    models = registry(split["train"].count(), 2)
    return run_models(models, split["train"], split["test"], 2, ["DecisionTree", "LogisticRegression", "NaiveBayes"], on_error="raise")


@query("study_binary")
def study_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw order lines to the comparison of models on the prepared table (all selected columns)."""
    prepared = prepare_binary(order_items(spark, sf_dir, customers_first=True), exclude=LEAKING)
    prepared = replace(prepared, table=materialize(prepared.table, "prepared"))
    table = run_study(prepared, LABEL, 2, ["DecisionTree", "LogisticRegression", "NaiveBayes"])
    return rounded(table.drop("train_time"), [c for c in results.COMPARED if c != "train_time"], 4)


@query("study_five_class")
def study_five_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the five classes, from the two raw tables."""
    a, b = stability_parts(spark, sf_dir)
    prepared = prepare_five_class(a, b, "stability", key="row_key")
    prepared = replace(prepared, table=materialize(prepared.table, "prepared"))
    table = run_study(prepared, "stability", 5, ["DecisionTree", "LogisticRegression", "NaiveBayes"])
    return rounded(table.drop("train_time"), [c for c in results.COMPARED if c != "train_time"], 4)


_GROUPS = {
    "time": ["processing_days", "days_for_shipment_scheduled"],
    "money": ["order_item_product_price", "order_item_discount", "order_profit_per_order", "tax"],
    "place": ["latitude_src", "longitude_src", "latitude_dest", "longitude_dest"],
}


_VARIANTS = {"full": FEATURES, **{f"no_{g}": [c for c in FEATURES if c not in cols] for g, cols in _GROUPS.items()}}


@query("ablation_run", f"""WITH {_LATE_ROWS}, {", ".join(S.tree(v, cols, "late", 2) for v, cols in _VARIANTS.items())},
scored AS ({" UNION ALL ".join(f"SELECT '{v}' AS model, y_true, y_pred, p1 AS score, y_true AS positive FROM {v}_pred" for v in _VARIANTS)}), """
       + record_sql("scored", "model,", "scored", "model,", "final AS (SELECT model, roc_auc, average_precision AS pr_auc FROM areas)")
       + f""" SELECT v.model AS variant, {", ".join(f"round(f.{m} - v.{m}, 6) + 0.0 AS {m}_decline" for m in results.ABLATION_METRICS)}
FROM record v JOIN record f ON f.model = 'full' WHERE v.model <> 'full'""")
def ablation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision tree without each feature group; decline of its metrics against the full one."""
    lines = materialize(order_items(spark, sf_dir, "row_key", *FEATURES, "late"), "lines")
    table = materialize(stratified_split(lines, "late", "row_key"), "unscaled")
    records = run_ablation(lambda: DecisionTree(max_depth=5), table, FEATURES, _GROUPS, "late")
    return rounded(results.ablation_deltas(records, "full"), [f"{m}_decline" for m in results.ABLATION_METRICS])


@query("scaler_roundtrip", f"""
WITH {S.ORDER_ITEMS}, {S.split("order_items", "late", "row_key")}
SELECT row_key, round((quantity - (SELECT avg(quantity) FROM split_rows WHERE split = 'train'))
  / (SELECT stddev_pop(quantity) FROM split_rows WHERE split = 'train'), 6) + 0.0 AS quantity FROM order_items""")
def scaler_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling parameters fitted on training rows, saved, loaded and applied to all rows."""
    lines = materialize(order_items(spark, sf_dir, "row_key", "late", "quantity"), "lines")
    rows = stratified_split(lines, "late", "row_key")
    path = f"{work_dir(spark)}/scaler"
    save_params(Standardizer.fit(rows.filter(F.col("split") == "train"), ["quantity"]).to_df(spark), path)
    return rounded(Standardizer.from_df(load_params(spark, path)).apply(rows).select("row_key", "quantity"), ["quantity"])


@query("model_roundtrip", f"WITH {_LATE_TREE} SELECT y_true, y_pred, count(*) AS count FROM t_pred GROUP BY 1, 2")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows per class as predicted by a fitted tree that was saved and loaded."""
    split = unscaled(spark, sf_dir, "late", FEATURES)
    path = f"{work_dir(spark)}/model"
    save_model(DecisionTree(max_depth=5).fit(split["train"]), path)
    return score(load_model(spark, path), split["test"]).groupBy("y_true", "y_pred").count()


@query("results_json", f"""
WITH {S.BINARY}, scored AS (SELECT shipping_mode AS model, y_true, y_pred FROM pred), {S.counts_by_class("model,", "scored")}, {S.summary("model,")}
SELECT model, n, round(accuracy, 6) AS accuracy, round(mcc, 6) + 0.0 AS mcc FROM summary""")
def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result records written as JSON lines and read back."""
    pred = binary_predictions(spark, sf_dir, "shipping_mode").withColumnRenamed("shipping_mode", "model")
    table = metrics.summary_metrics(metrics.confusion(pred, ["model"]), ["model"])
    path = stamped(f"{work_dir(spark)}/results")
    write_results(rounded(table.select("model", "n", "accuracy", "mcc"), ["accuracy", "mcc"]), path)
    return read_table(spark, path, "model string, n long, accuracy double, mcc double", fmt="json")


@query("report_csv", f"""{_FIVE}
SELECT CAST(class AS VARCHAR) AS row, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM class_metrics""")
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class rows of a classification report written as CSV and read back."""
    report = metrics.classification_report(multi_predictions(spark, sf_dir))
    path = f"{work_dir(spark)}/report"
    write_report(rounded(report, ["precision", "recall", "f1", "class_accuracy"]), path)
    schema = "row string, precision double, recall double, f1 double, support long, class_accuracy double"
    return read_table(spark, path, schema, fmt="csv").filter(F.col("class_accuracy").isNotNull()).drop("class_accuracy")
