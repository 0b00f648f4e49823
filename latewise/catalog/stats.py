"""Queries: counts, missing values, selection, splits and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.catalog import sql as S
from latewise.catalog.registry import query, r, rounded
from latewise.catalog.tables import _NULLS, _with_nulls
from latewise.operators import profile as P
from latewise.operators import select
from latewise.operators.scale import Standardizer
from latewise.operators.split import stratified_split, unique_key
from latewise.plans.binary import materialize
from latewise.sources.order_items import binary_predictions, load, order_items


@query("value_counts", f"WITH {S.ORDER_ITEMS} SELECT processing_days, count(*) AS n FROM order_items GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_counts(order_items(spark, sf_dir, "processing_days"), "processing_days")


@query("class_ratio", f"""
WITH {S.ORDER_ITEMS}, {S.split("order_items", "stability", "row_key")},
n AS (SELECT split, stability AS class, count(*) AS n FROM split_rows GROUP BY 1, 2)
SELECT split, class, n, round(n / (sum(n) OVER (PARTITION BY split))::DOUBLE * 100, 2) AS percent FROM n""")
def class_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_items(spark, sf_dir, "row_key", "stability")
    return P.class_ratio(stratified_split(rows, "stability", "row_key"), "stability")


@query("missing_report", f"""
WITH {_NULLS}
SELECT * FROM (
  SELECT 'discount_rate' AS "column", count(*) - count(discount_rate) AS n_null FROM holes
  UNION ALL SELECT 'delivery_status', count(*) - count(delivery_status) FROM holes
  UNION ALL SELECT 'quantity', count(*) - count(quantity) FROM holes
  UNION ALL SELECT 'row_key', count(*) - count(row_key) FROM holes
  UNION ALL SELECT 'stability', count(*) - count(stability) FROM holes
  UNION ALL SELECT 'tax', count(*) - count(tax) FROM holes
  UNION ALL SELECT 'order_id', count(*) - count(order_id) FROM holes) WHERE n_null > 0""")
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.missing_report(_with_nulls(spark, sf_dir))


@query("profile", """SELECT count(*) AS n_rows, 11 AS n_columns, 8 AS n_numeric, 3 AS n_other FROM lineitem""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(load(spark, sf_dir, "lineitem"))


@query("prediction_distribution", f"""
WITH {S.BINARY}
SELECT 'true' AS kind, y_true AS class, count(*) AS n FROM pred GROUP BY 2
UNION ALL SELECT 'predicted', y_pred, count(*) FROM pred GROUP BY 2""")
def prediction_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prediction_distribution(binary_predictions(spark, sf_dir))


NUMERIC = [
    "processing_days", "order_item_product_price", "product_price", "order_item_discount", "order_profit_per_order",
    "latitude_src", "longitude_src", "latitude_dest", "longitude_dest", "quantity", "tax", "discount_rate",
    "days_for_shipping_real", "days_for_shipment_scheduled", "line_number",
]


def _numeric(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    rows = order_items(spark, sf_dir, *extra, *NUMERIC)
    return rows.withColumn("is_shipping_date_holiday", F.lit(0))


_LONG = f"""{S.ORDER_ITEMS}, long AS (
  UNPIVOT (SELECT row_key, late, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)}, 0::DOUBLE AS is_shipping_date_holiday FROM order_items)
  ON COLUMNS(* EXCLUDE (row_key, late)) INTO NAME feature VALUE x),
places AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate([*NUMERIC, "is_shipping_date_holiday"]))}) AS v(feature, place))"""

_RANK = """row_number() OVER (ORDER BY isnan(f), CASE WHEN f > 0 AND NOT isinf(f)
    THEN round(f / pow(10, floor(log10(f))), 9) * pow(10, floor(log10(f))) ELSE f END DESC, place DESC) AS rank"""

_F = """per_class AS (
  SELECT feature, late, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1, 2),
centre AS (SELECT feature, sum(n * m) / sum(n) AS c FROM per_class GROUP BY 1),
sums AS (
  SELECT feature, sum(n * pow(m - c, 2)) AS between_ss, sum(n * v) AS within_ss, sum(n) AS n, count(*) AS k
  FROM per_class JOIN centre USING (feature) GROUP BY 1),
scores AS (
  SELECT feature, place, CASE WHEN within_ss = 0 AND between_ss = 0 THEN 'NaN'::DOUBLE WHEN within_ss = 0 THEN 'Infinity'::DOUBLE
    ELSE between_ss * (n - k) / (within_ss * (k - 1)) END AS f FROM sums JOIN places USING (feature))"""


@query("variance_filter", f"""
WITH {_LONG}
SELECT feature AS "column", round(var_pop(x), 4) + 0.0 AS variance FROM long GROUP BY 1 HAVING var_pop(x) > 0.01""")
def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that pass the variance filter, with their variance; the constant column does not."""
    table = select.variances(_numeric(spark, sf_dir))
    return table.filter(F.col("variance") > select.VARIANCE_THRESHOLD).select("column", r("variance", 4).alias("variance"))


@query("anova_f", f"""WITH {_LONG}, {_F} SELECT feature AS "column", round(f, 4) + 0.0 AS f FROM scores WHERE NOT isnan(f)""")
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numeric(spark, sf_dir, "late")
    scores = select.anova_f(rows, [*NUMERIC, "is_shipping_date_holiday"], "late")
    return scores.filter(~F.isnan("f")).select("column", r("f", 4).alias("f"))


@query("select_k_best", f"""
WITH {_LONG}, {_F}
SELECT feature AS "column", round(f, 4) + 0.0 AS f, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, {_RANK} FROM scores) WHERE rank <= 8""")
def select_k_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best columns with their scores."""
    rows = _numeric(spark, sf_dir, "late")
    ranked = select.rank_columns(select.anova_f(rows, [*NUMERIC, "is_shipping_date_holiday"], "late"))
    return ranked.filter(F.col("rank") <= 8).select("column", r("f", 4).alias("f"), "rank")


@query("select_features", f"""
WITH {_LONG}, passed AS (SELECT feature FROM long GROUP BY 1 HAVING var_pop(x) > 0.01), {_F}, best AS (
  SELECT feature FROM (SELECT *, {_RANK}
    FROM scores WHERE feature IN (SELECT feature FROM passed)) WHERE rank <= 6)
SELECT late, feature, count(*) AS n, round(avg(x), 4) + 0.0 AS mean FROM long JOIN best USING (feature) GROUP BY 1, 2""")
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each selected column (six of them) per label, over all rows of the selected table."""
    rows = _numeric(spark, sf_dir, "row_key", "late")
    chosen = select.select_features(rows, "late", k=6, keep=("row_key",))
    return feature_means(chosen, "late")


def feature_means(df: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """Rows and mean per group and numeric column, from one aggregate."""
    cols = [c for c in df.columns if c not in ("row_key", *by)]
    means = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).cast("double")).alias("mean")) for c in cols]).alias("m"),
    )
    return means.select(*by, "n", F.explode("m").alias("m")).select(*by, "n", "m.feature", r("m.mean", digits).alias("mean"))


_TESTED = f"""{_LONG}, {_F}, counted AS (
  SELECT feature, f, k, n FROM scores JOIN (SELECT feature, k, n FROM sums) USING (feature)), {S.f_tails("counted")}"""


@query("feature_p_values", f"""WITH RECURSIVE {_TESTED} SELECT feature AS "column", round(p, 6) + 0.0 AS p FROM tails""")
def feature_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The p value of every testable column in the F test."""
    tested = select.p_values(_numeric(spark, sf_dir, "late"), [*NUMERIC, "is_shipping_date_holiday"], "late")
    return tested.filter(~F.isnan("p")).select("column", r("p").alias("p"))


@query("feature_validity", f"""WITH RECURSIVE {_TESTED}
SELECT count(*) FILTER (p < 0.05) AS n_effective, count(*) FILTER (p > 0.01) AS n_weak, (SELECT count(*) FROM places) AS n_columns FROM tails""")
def feature_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective and weak columns by p value."""
    return select.feature_validity(_numeric(spark, sf_dir, "late"), [*NUMERIC, "is_shipping_date_holiday"], "late")


@query("stratified_split", f"""
WITH {S.ORDER_ITEMS}, {S.split("order_items", "late", "row_key")} SELECT row_key, late, split FROM split_rows""")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = materialize(order_items(spark, sf_dir, "row_key", "late"), "lines", "zstd")
    return stratified_split(lines, "late", "row_key")


_CONTENT = "md5(concat_ws('|', coalesce('=' || order_id, '~'), coalesce('=' || quantity, '~'), coalesce('=' || late, '~')))"


@query("split_duplicate_keys", f"""
WITH {S.ORDER_ITEMS}, narrow AS (SELECT order_id, quantity, late, {_CONTENT} AS content FROM order_items),
keyed AS (SELECT *, content || '-' || row_number() OVER (PARTITION BY content) AS own_key FROM narrow),
{S.split("keyed", "late", "own_key")}
SELECT late, split, count(*) AS n, count(DISTINCT own_key) AS n_keys, min(own_key) AS first_key FROM split_rows GROUP BY 1, 2""")
def split_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat get keys of their own, so the parts have their exact sizes."""
    rows = order_items(spark, sf_dir, "order_id", "quantity", "late")
    rows = unique_key(rows, "own_key", ["order_id", "quantity", "late"]).select("late", "own_key")
    rows = materialize(rows, "keyed", "zstd")
    return stratified_split(rows, "late", "own_key").groupBy("late", "split").agg(
        F.count("*").alias("n"), F.count_distinct("own_key").alias("n_keys"), F.min("own_key").alias("first_key"))


_SCALED = ["order_item_product_price", "discount_rate", "latitude_dest", "quantity"]


@query("standardize", f"""
WITH {S.ORDER_ITEMS}, {S.split("order_items", "late", "row_key")},
fitted AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED)} FROM split_rows WHERE split = 'train')
SELECT row_key, split, {", ".join(f"round(({c} - m_{c}) / s_{c}, 5) + 0.0 AS {c}" for c in _SCALED)} FROM split_rows, fitted""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns of all splits scaled with the statistics of the training split."""
    lines = materialize(order_items(spark, sf_dir, "row_key", "late", *_SCALED), "lines")
    rows = stratified_split(lines, "late", "row_key")
    scaler = Standardizer.fit(rows.filter(F.col("split") == "train"), _SCALED)
    return rounded(scaler.apply(rows), _SCALED, 5).drop("late")
