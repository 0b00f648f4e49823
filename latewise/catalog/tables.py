"""Queries: sources and sinks, cleaning, features, encoding, set operations."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.catalog import sql as S
from latewise.catalog.registry import query, r
from latewise.functions import argmax, geodesic_km, haversine_km, manhattan_deg, normalize_probs, softmax
from latewise.operators import clean, encode, features
from latewise.session import work_dir
from latewise.sources.order_items import class_weights, load, order_items
from latewise.sources.tables import read_split, read_table, to_xy, write_splits

_RISK = ["days_for_shipping_real", "days_for_shipment_scheduled"]


@query("delay_overview", f"""
WITH {S.ORDER_ITEMS}, binned AS (
  SELECT late, CASE WHEN order_item_product_price > 0 THEN order_item_discount / order_item_product_price ELSE 0 END AS share,
    CASE WHEN processing_days <= -1 THEN NULL WHEN processing_days <= 0 THEN '0_days' WHEN processing_days <= 2 THEN '1_2_days'
      WHEN processing_days <= 4 THEN '3_4_days' WHEN processing_days <= 6 THEN '5_6_days' ELSE '7_plus_days' END AS processing_bin,
    CASE WHEN product_price <= 0 THEN NULL WHEN product_price <= 50 THEN 'Very_Low' WHEN product_price <= 100 THEN 'Low'
      WHEN product_price <= 200 THEN 'Medium' WHEN product_price <= 500 THEN 'High' ELSE 'Very_High' END AS price_range
  FROM order_items)
SELECT processing_bin, price_range, count(*) AS n, round(avg(late), 6) + 0.0 AS delay_rate,
  round(avg(share), 6) + 0.0 AS discount_share
FROM binned GROUP BY ALL""")
def delay_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay rate and discount share by processing bin and price range (the flagship query)."""
    rows = order_items(
        spark, sf_dir, "order_date", "shipping_date", *_RISK, "order_item_product_price",
        "order_item_discount", "order_profit_per_order", "product_price",
    )
    rows = features.finance_features(features.delivery_features(features.time_features(rows)))
    bins = features.price_range(F.col("product_price")).alias("price_range")
    return (
        rows.groupBy(F.col("order_processing_days_binned").alias("processing_bin"), bins)
        .agg(F.count("*").alias("n"), r(F.avg("delivery_risk")).alias("delay_rate"),
             r(F.avg("discount_percentage")).alias("discount_share"))
        .orderBy("processing_bin", "price_range")
    )


_ORDER_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@query("scan_csv", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS order_day, o_orderpriority FROM orders""")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders written as headed CSV and scanned back with an explicit schema."""
    path = f"{work_dir(spark)}/orders-csv"
    load(spark, sf_dir, "orders").write.option("header", True).csv(path)
    orders = read_table(spark, path, _ORDER_SCHEMA, required=["o_orderkey", "o_orderpriority"], fmt="csv")
    return orders.withColumn("order_day", F.date_format("o_orderdate", "yyyy-MM-dd")).drop("o_orderdate")


@query("split_roundtrip", f"""
WITH {S.ORDER_ITEMS}, {S.split("order_items", "late", "row_key")}
SELECT split, row_key, late, order_item_product_price FROM split_rows""")
def split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines split, written with one folder per split, and every split read back."""
    from latewise.operators.split import stratified_split
    from latewise.plans.binary import materialize

    rows = materialize(order_items(spark, sf_dir, "row_key", "late", "order_item_product_price"), "lines", "zstd")
    path = f"{work_dir(spark)}/splits"
    write_splits(stratified_split(rows, "late", "row_key"), path)
    schema = "row_key string, late int, order_item_product_price double, split string"
    parts = [read_split(spark, path, name, schema=schema) for name in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("xy_matrix", f"""
WITH {S.ORDER_ITEMS}
SELECT row_key, CAST(late AS DOUBLE) AS label, order_item_product_price AS x0, order_item_discount + 0.0 AS x1,
  CAST(processing_days AS DOUBLE) AS x2 FROM order_items""")
def xy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_items(spark, sf_dir, "row_key", "late", "order_item_product_price", "order_item_discount", "processing_days")
    xy = to_xy(rows, "late", keep=["row_key"]).withColumn("x", vector_to_array("features"))
    return xy.select("row_key", "label", *[(F.col("x")[i] + F.lit(0.0)).alias(f"x{i}") for i in range(3)])


@query("drop_columns", f"""
WITH {S.ORDER_ITEMS}
SELECT row_key, order_id, order_item_product_price FROM order_items""")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_items(spark, sf_dir, "row_key", "order_id", "customer_fname", "order_item_id", "order_item_product_price")
    return clean.drop_columns(rows)


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading columns and two later ones with nulls: zero discounts and status 'O' are taken as missing."""
    rows = order_items(spark, sf_dir, "discount_rate", "delivery_status", "quantity", "row_key", "stability", "tax", "order_id")
    return rows.select(
        F.nullif("discount_rate", F.lit(0.0)).alias("discount_rate"),
        F.nullif("delivery_status", F.lit("O")).alias("delivery_status"),
        "quantity", "row_key", "stability", F.nullif("tax", F.lit(0.0)).alias("tax"), "order_id",
    )


_NULLS = f"""{S.ORDER_ITEMS}, holes AS (
  SELECT nullif(discount_rate, 0) AS discount_rate, nullif(delivery_status, 'O') AS delivery_status,
    quantity, row_key, stability, nullif(tax, 0) AS tax, order_id FROM order_items)"""


@query("fill_all", f"""
WITH {_NULLS}
SELECT row_key, coalesce(discount_rate, 0) AS discount_rate, coalesce(delivery_status, '0') AS delivery_status,
  quantity, stability, coalesce(tax, 0) AS tax, order_id FROM holes""")
def fill_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.fill_all(_with_nulls(spark, sf_dir))


@query("fill_leading", f"""
WITH {_NULLS}
SELECT row_key, coalesce(discount_rate, 0) AS discount_rate, coalesce(delivery_status, '0') AS delivery_status,
  quantity, stability, tax, order_id FROM holes""")
def fill_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.fill_leading(_with_nulls(spark, sf_dir))


@query("fill_numeric", f"""
WITH {_NULLS}
SELECT row_key, coalesce(discount_rate, 0) AS discount_rate, delivery_status, quantity, stability,
  coalesce(tax, 0) AS tax, order_id FROM holes""")
def fill_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.fill_numeric(_with_nulls(spark, sf_dir), "stability")


@query("fill_null_counts", f"""
WITH {_NULLS}
SELECT 'leading' AS part, 5 * count(*) - count(row_key) - count(discount_rate) - count(delivery_status) - count(quantity) - count(stability) AS n_null
FROM holes UNION ALL SELECT 'numeric', 2 * count(*) - count(tax) - count(order_id) FROM holes""")
def fill_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nulls that the two fills find."""
    return clean.null_totals(_with_nulls(spark, sf_dir), "stability")


def stability_parts(spark: SparkSession, sf_dir: str, *extra: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping five-class tables: lines of type A or R, and lines of type A or N."""
    cols = ["discount_rate", "tax", "quantity", "line_number", "supplier_id", "order_item_product_price", "stability", "row_key"]
    rows = order_items(spark, sf_dir, *cols, "type")
    holes = rows.withColumns({"discount_rate": F.nullif("discount_rate", F.lit(0.0)), "tax": F.nullif("tax", F.lit(0.0))})
    return tuple(holes.filter(F.col("type").isin(*kinds)).drop("type") for kinds in (("A", "R"), ("A", "N")))


@query("merge_dedup", f"""
WITH {S.ORDER_ITEMS}
SELECT discount_rate, tax, quantity, supplier_id, order_item_product_price, stability, row_key, line_number FROM (
  SELECT nullif(discount_rate, 0) AS discount_rate, nullif(tax, 0) AS tax, quantity, line_number, supplier_id,
    order_item_product_price, stability, row_key FROM order_items WHERE type IN ('A', 'R')
  UNION
  SELECT nullif(discount_rate, 0), nullif(tax, 0), quantity, NULL, supplier_id,
    order_item_product_price, stability, row_key FROM order_items WHERE type IN ('A', 'N'))""")
def merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second table lacks a column, so a line in both appears once with it and once with null."""
    a, b = stability_parts(spark, sf_dir)
    return clean.merge_dedup(a, b.drop("line_number"))


@query("parse_dates", f"""
WITH {S.ORDER_ITEMS}
SELECT row_key, epoch_us(order_date) AS order_us, epoch_us(shipping_date) AS shipping_us FROM order_items""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.parse_dates(order_items(spark, sf_dir, "row_key", "order_date_dateorders", "shipping_date_dateorders"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return rows.select(
        "row_key", F.timestamp_diff("MICROSECOND", epoch, "order_date").alias("order_us"),
        F.timestamp_diff("MICROSECOND", epoch, "shipping_date").alias("shipping_us"),
    )


_DAYS = "CAST(floor((epoch_us(shipping_date) - epoch_us(order_date)) / 86400000000) AS INTEGER)"


@query("processing_days", f"WITH {S.ORDER_ITEMS} SELECT row_key, {_DAYS} AS order_processing_days FROM order_items")
def processing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.time_features(order_items(spark, sf_dir, "row_key", "order_date", "shipping_date"))
    return rows.select("row_key", "order_processing_days")


@query("processing_bins", f"""
WITH {S.ORDER_ITEMS}, d AS (SELECT row_key, {_DAYS} AS days FROM order_items)
SELECT row_key, CASE WHEN days <= -1 THEN NULL WHEN days <= 0 THEN '0_days' WHEN days <= 2 THEN '1_2_days'
  WHEN days <= 4 THEN '3_4_days' WHEN days <= 6 THEN '5_6_days' ELSE '7_plus_days' END AS order_processing_days_binned
FROM d""")
def processing_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.time_features(order_items(spark, sf_dir, "row_key", "order_date", "shipping_date"))
    return rows.select("row_key", "order_processing_days_binned")


@query("calendar_parts", f"""
WITH {S.ORDER_ITEMS}
SELECT row_key, CAST(month(order_date) AS INTEGER) AS order_month, CAST(quarter(order_date) AS INTEGER) AS order_quarter,
  CAST(isodow(order_date) - 1 AS INTEGER) AS order_weekday,
  CASE WHEN isodow(order_date) >= 6 THEN 1 ELSE 0 END AS is_weekend_order FROM order_items""")
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.time_features(order_items(spark, sf_dir, "row_key", "order_date", "shipping_date"))
    return rows.select("row_key", "order_month", "order_quarter", "order_weekday", "is_weekend_order")


@query("delivery_labels", f"""
WITH {S.ORDER_ITEMS}, d AS (SELECT *, days_for_shipping_real - days_for_shipment_scheduled AS delay FROM order_items)
SELECT row_key, delay AS shipping_delay_days, CASE WHEN delay > 0 THEN 1 ELSE 0 END AS delivery_risk,
  CASE WHEN delay <= 0 THEN 1 ELSE 0 END AS on_time_delivery FROM d""")
def delivery_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.delivery_features(order_items(spark, sf_dir, "row_key", *_RISK))
    return rows.select("row_key", "shipping_delay_days", "delivery_risk", "on_time_delivery")


@query("finance_ratios", f"""
WITH {S.ORDER_ITEMS}, f AS (SELECT *, order_item_product_price - order_item_discount AS pay FROM order_items)
SELECT row_key,
  round(CASE WHEN days_for_shipment_scheduled > 0 THEN days_for_shipping_real / days_for_shipment_scheduled::DOUBLE ELSE 0 END, 6) + 0.0 AS delivery_efficiency_ratio,
  round(CASE WHEN order_item_product_price > 0 THEN order_item_discount / order_item_product_price ELSE 0 END, 6) + 0.0 AS discount_percentage,
  round(pay, 4) + 0.0 AS actual_payment,
  round(CASE WHEN pay > 0 THEN order_profit_per_order / pay ELSE 0 END, 6) + 0.0 AS profit_margin FROM f""")
def finance_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_items(spark, sf_dir, "row_key", *_RISK, "order_item_product_price", "order_item_discount", "order_profit_per_order")
    rows = features.finance_features(features.delivery_features(rows))
    return rows.select(
        "row_key", r("delivery_efficiency_ratio").alias("delivery_efficiency_ratio"),
        r("discount_percentage").alias("discount_percentage"), r("actual_payment", 4).alias("actual_payment"),
        r("profit_margin").alias("profit_margin"),
    )


@query("price_range", f"""
WITH {S.ORDER_ITEMS}
SELECT row_key, CASE WHEN product_price <= 0 THEN NULL WHEN product_price <= 50 THEN 'Very_Low' WHEN product_price <= 100 THEN 'Low'
  WHEN product_price <= 200 THEN 'Medium' WHEN product_price <= 500 THEN 'High' ELSE 'Very_High' END AS price_range
FROM order_items""")
def price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_items(spark, sf_dir, "row_key", "product_price")
    return rows.select("row_key", features.price_range(F.col("product_price")).alias("price_range"))


_ENDS = ["latitude_src", "longitude_src", "latitude_dest", "longitude_dest"]

_HAVERSINE = """2 * asin(sqrt(least(1, pow(sin(({lat2} - {lat1}) / 2), 2)
  + cos({lat1}) * cos({lat2}) * pow(sin(radians(longitude_dest - longitude_src) / 2), 2))))"""

_GEO = f"""{S.ORDER_ITEMS}, moved AS (SELECT * REPLACE (latitude_src + @north AS latitude_src) FROM order_items), reduced AS (
  SELECT *, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(latitude_src))) AS b1,
    atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(latitude_dest))) AS b2 FROM moved),
angles AS (
  SELECT *, {_HAVERSINE.format(lat1="b1", lat2="b2")} AS s, (b1 + b2) / 2 AS p, (b2 - b1) / 2 AS q FROM reduced),
lambert AS (
  SELECT row_key, latitude_src, longitude_src, latitude_dest, longitude_dest,
    CASE WHEN s <= 0 THEN 0 ELSE 6378.137::DOUBLE * (s - 1 / 298.257223563::DOUBLE / 2 * (
      (s - sin(s)) * pow(sin(p) * cos(q), 2) / pow(cos(s / 2), 2)
      + (s + sin(s)) * pow(cos(p) * sin(q), 2) / pow(sin(s / 2), 2))) END AS km
  FROM angles)"""


@query("geo_distance", f"WITH {_GEO} SELECT row_key, round(km, 4) + 0.0 AS km FROM lambert".replace("@north", "0"))
def geo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_items(spark, sf_dir, "row_key", *_ENDS)
    return rows.select("row_key", r(geodesic_km(*[F.col(c) for c in _ENDS]), 4).alias("km"))


@query("geo_haversine", f"""
WITH {S.ORDER_ITEMS}
SELECT row_key, round(6371.009::DOUBLE * {_HAVERSINE.format(lat1="radians(latitude_src)", lat2="radians(latitude_dest)")}, 4) + 0.0 AS km
FROM order_items""")
def geo_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_items(spark, sf_dir, "row_key", *_ENDS)
    return rows.select("row_key", r(haversine_km(*[F.col(c) for c in _ENDS]), 4).alias("km"))


@query("geo_fallback", f"""
WITH {_GEO}
SELECT row_key, round(CASE WHEN latitude_src > 90 THEN degrees ELSE km END, 4) + 0.0 AS distance, round(degrees, 4) + 0.0 AS degrees
FROM (SELECT *, abs(latitude_dest - latitude_src) + abs(longitude_dest - longitude_src) AS degrees FROM lambert)""".replace("@north", "100"))
def geo_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources moved north by 100 degrees: those beyond the pole have no distance and fall back to degrees."""
    rows = order_items(spark, sf_dir, "row_key", *_ENDS)
    moved = features.geo_features(rows.withColumn("latitude_src", F.col("latitude_src") + 100))
    return moved.select(
        "row_key", r("haversine_distance", 4).alias("distance"),
        r(manhattan_deg(*[F.col(c) for c in _ENDS]), 4).alias("degrees"),
    )


@query("order_distinct_items", f"""
WITH {S.ORDER_ITEMS}, n AS (
  SELECT order_id, count(DISTINCT order_item_cardprod_id) AS order_num_distinct_items FROM order_items GROUP BY 1)
SELECT row_key, order_num_distinct_items FROM order_items JOIN n USING (order_id)""")
def order_distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.order_distinct_items(order_items(spark, sf_dir, "row_key", "order_id", "order_item_cardprod_id"))
    return rows.select("row_key", "order_num_distinct_items")


_ENCODED = ["category_name", "customer_segment", "department_name", "market", "order_status", "shipping_mode", "customer_country", "product_name"]


@query("label_encode", f"""
WITH {S.ORDER_ITEMS}
SELECT row_key, {", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" for c in _ENCODED)} FROM order_items""")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.label_encode(order_items(spark, sf_dir, "row_key", *_ENCODED))


@query("label_encode_large", f"""
WITH {S.ORDER_ITEMS} SELECT row_key, CAST(dense_rank() OVER (ORDER BY customer_fname) - 1 AS INTEGER) AS customer_fname FROM order_items""")
def label_encode_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same codes by the distributed code table, as used for columns with very many values."""
    rows = order_items(spark, sf_dir, "row_key", "customer_fname")
    return encode.LabelEncoder.fit(rows, ["customer_fname"], max_labels=0).apply(rows)


@query("label_encode_unseen", f"""
WITH {S.ORDER_ITEMS}, known AS (
  SELECT customer_fname, dense_rank() OVER (ORDER BY customer_fname) - 1 AS code FROM (
    SELECT DISTINCT customer_fname FROM order_items WHERE type = 'A')),
coded AS (
  SELECT row_key, CAST(coalesce(code, (SELECT count(*) FROM known)) AS INTEGER) AS code
  FROM order_items LEFT JOIN known USING (customer_fname))
SELECT row_key, code AS small, code AS large FROM coded""")
def label_encode_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes fitted on part of the rows, by the indexer and by the distributed table; other values share a code."""
    rows = order_items(spark, sf_dir, "row_key", "customer_fname", "type").withColumn("other", F.col("customer_fname"))
    known = rows.filter(F.col("type") == "A")
    small = encode.LabelEncoder.fit(known, ["customer_fname"], unseen="keep")
    large = encode.LabelEncoder.fit(known, ["other"], max_labels=0, unseen="keep")
    coded = large.apply(small.apply(rows))
    return coded.select("row_key", F.col("customer_fname").alias("small"), F.col("other").alias("large"))


def _dummies(col: str, levels: list) -> str:
    parts = [f"CASE WHEN CAST({col} AS VARCHAR) = '{v}' THEN 1 ELSE 0 END AS \"{col}_{v}\"" for v in levels]
    return ", ".join([*parts, f"CASE WHEN {col} IS NULL THEN 1 ELSE 0 END AS {col}_nan"])


@query("one_hot", f"""
WITH {S.ORDER_ITEMS}, d AS (
  SELECT row_key, type, delivery_status, CASE WHEN days_for_shipping_real <= days_for_shipment_scheduled THEN 1 ELSE 0 END AS on_time_delivery,
    CASE WHEN isodow(order_date) >= 6 THEN 1 ELSE 0 END AS is_weekend_order,
    CASE WHEN product_price <= 50 THEN 'Very_Low' WHEN product_price <= 100 THEN 'Low' WHEN product_price <= 200 THEN 'Medium'
      WHEN product_price <= 500 THEN 'High' ELSE 'Very_High' END AS price_range,
    CASE WHEN processing_days <= -1 THEN NULL WHEN processing_days <= 0 THEN '0_days' WHEN processing_days <= 2 THEN '1_2_days'
      WHEN processing_days <= 4 THEN '3_4_days' WHEN processing_days <= 6 THEN '5_6_days' ELSE '7_plus_days' END AS order_processing_days_binned
  FROM order_items)
SELECT row_key, {_dummies("type", ["A", "N", "R"])}, {_dummies("delivery_status", ["F", "O"])},
  {_dummies("on_time_delivery", [0, 1])}, {_dummies("is_weekend_order", [0, 1])},
  {_dummies("price_range", ["High", "Low", "Medium", "Very_High", "Very_Low"])},
  {_dummies("order_processing_days_binned", ["0_days", "1_2_days", "3_4_days", "5_6_days", "7_plus_days"])} FROM d""")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_items(spark, sf_dir, "row_key", "type", "delivery_status", "order_date", "shipping_date", *_RISK, "product_price")
    rows = features.delivery_features(features.time_features(rows))
    rows = rows.withColumn("price_range", features.price_range(F.col("product_price")))
    return encode.one_hot(rows.select("row_key", *encode.ONE_HOT))


@query("label_binarize", f"""
WITH {S.WEIGHTS}
SELECT row_key, {", ".join(f"CASE WHEN y_true = {k} THEN 1 ELSE 0 END AS is_class_{k}" for k in range(5))} FROM weights""")
def label_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_items(spark, sf_dir, "row_key", "stability")
    return encode.binarize_label(rows, "stability", list(range(5))).drop("stability")


_KEPT = [0, 1, 3, 4]
_SUM_W = "w0 + w1 + w2 + w3 + w4"


@query("prob_normalize", f"""
WITH {S.WEIGHTS}
SELECT row_key, {", ".join(f"round(w{k} / ({_SUM_W} + 1e-12), 6) + 0.0 AS p{k}" for k in _KEPT)} FROM weights""")
def prob_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw weights as probabilities, of which four observed classes are kept."""
    rows = class_weights(spark, sf_dir).withColumn("p", normalize_probs(F.col("weights"), _KEPT))
    return rows.select("row_key", *[r(F.col("p")[i]).alias(f"p{k}") for i, k in enumerate(_KEPT)])


_EXPS = " + ".join(f"exp((w{k} - greatest(w0, w1, w2, w3, w4)) / 20)" for k in range(5))


@query("softmax_argmax", f"""
WITH {S.MULTI}
SELECT row_key, y_pred, {", ".join(f"round(exp((w{k} - greatest(w0, w1, w2, w3, w4)) / 20) / ({_EXPS}), 6) + 0.0 AS p{k}" for k in range(5))}
FROM weights JOIN pred USING (row_key)""")
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = class_weights(spark, sf_dir).withColumn("logits", F.transform("weights", lambda w: w / 20))
    rows = rows.withColumn("p", softmax(F.col("logits")))
    return rows.select(
        "row_key", argmax(F.col("logits")).alias("y_pred"), *[r(F.col("p")[k]).alias(f"p{k}") for k in range(5)]
    )


@query("first_n_sample", f"WITH {S.ORDER_ITEMS} SELECT row_key, late, quantity FROM order_items ORDER BY row_key LIMIT 100")
def first_n_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.first_n(order_items(spark, sf_dir, "row_key", "late", "quantity"), "row_key", 100)
