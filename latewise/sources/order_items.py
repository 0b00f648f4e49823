"""Order lines of the delay study, derived from the star-schema tables.

A column costs only the joins it needs: dimension keys are unique, so a left join never changes the rows
and a dimension whose columns are not asked for is not joined. No join carries a broadcast hint; the
optimizer broadcasts a side only when its statistics put it below ``autoBroadcastJoinThreshold`` and
adaptive execution splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.functions import argmax, whole_days_between

DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Declared, so that planning a query does not start a job that opens file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _elapsed() -> Column:
    return whole_days_between(F.col("o_orderdate"), F.col("l_shipdate"))


def _processing() -> Column:
    return F.pmod(_elapsed(), F.lit(10)) - 1


def _real() -> Column:
    return F.pmod(_elapsed(), F.lit(7))


def _scheduled() -> Column:
    return F.substring("o_orderpriority", 1, 1).cast("int") - 1


def _shipping() -> Column:
    return F.timestamp_add("DAY", _processing(), F.col("o_orderdate"))


def _row_key() -> Column:
    return F.concat_ws(
        "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.floor(F.col("l_extendedprice") * 100 + 0.5), F.unix_date(F.col("l_shipdate").cast("date")),
    )


_NONE: set[str] = set()
_ORDER, _PART, _SUPPLIER = {"orders"}, {"part"}, {"supplier"}
_CUSTOMER = {"orders", "customer"}
_PLACE = {"orders", "customer", "nation", "region"}

# Column: (tables it needs besides lineitem, source column or expression).
_DEFINITIONS: dict[str, tuple[set[str], str | Callable[[], Column]]] = {
    "row_key": (_NONE, _row_key),
    "order_id": (_NONE, "l_orderkey"),
    "order_item_id": (_NONE, "l_linenumber"),
    "order_item_cardprod_id": (_NONE, "l_partkey"),
    "product_card_id": (_NONE, "l_partkey"),
    "supplier_id": (_NONE, "l_suppkey"),
    "line_number": (_NONE, "l_linenumber"),
    "customer_id": (_ORDER, "o_custkey"),
    "customer_fname": (_CUSTOMER, "c_name"),
    "order_date": (_ORDER, "o_orderdate"),
    "shipping_date": (_ORDER, _shipping),
    "order_date_dateorders": (_ORDER, lambda: F.date_format("o_orderdate", DATE_FORMAT)),
    "shipping_date_dateorders": (_ORDER, lambda: F.date_format(_shipping(), DATE_FORMAT)),
    "processing_days": (_ORDER, _processing),
    "days_for_shipping_real": (_ORDER, _real),
    "days_for_shipment_scheduled": (_ORDER, _scheduled),
    "late": (_ORDER, lambda: F.when(_real() > _scheduled(), F.lit(1)).otherwise(F.lit(0))),
    "order_item_product_price": (_NONE, "l_extendedprice"),
    "product_price": (_NONE, lambda: F.col("l_extendedprice") / 100),
    "order_item_discount": (_NONE, lambda: F.col("l_extendedprice") * F.col("l_discount")),
    "order_profit_per_order": (_NONE, lambda: F.col("l_extendedprice") * (F.lit(0.05) - F.col("l_discount"))),
    "latitude_src": (_SUPPLIER, lambda: F.lit(-20.0) + F.lit(1.6) * F.col("s_nationkey")),
    "longitude_src": (_SUPPLIER, lambda: F.lit(-30.0) + F.lit(2.5) * F.col("s_nationkey")),
    "latitude_dest": (_CUSTOMER, lambda: F.lit(15.0) - F.lit(1.3) * F.col("c_nationkey")),
    "longitude_dest": (_CUSTOMER, lambda: F.lit(35.0) - F.lit(2.1) * F.col("c_nationkey")),
    "shipping_mode": (_ORDER, "o_orderpriority"),
    "order_status": (_ORDER, "o_orderstatus"),
    "customer_segment": (_CUSTOMER, "c_mktsegment"),
    "customer_country": (_PLACE, "n_name"),
    "market": (_PLACE, "r_name"),
    "department_name": (_PART, "p_brand"),
    "category_name": (_PART, "p_type"),
    "product_name": (_PART, "p_name"),
    "type": (_NONE, "l_returnflag"),
    "delivery_status": (_NONE, "l_linestatus"),
    "quantity": (_NONE, "l_quantity"),
    "tax": (_NONE, "l_tax"),
    "discount_rate": (_NONE, "l_discount"),
    "stability": (_NONE, lambda: F.pmod(F.col("l_quantity") + F.col("l_linenumber"), F.lit(5.0)).cast("int")),
}


def _column(name: str) -> Column:
    source = _DEFINITIONS[name][1]
    return (F.col(source) if isinstance(source, str) else source()).alias(name)


RAW_COLUMNS = [
    "row_key", "order_id", "order_item_cardprod_id", "customer_id", "product_card_id", "customer_fname",
    "order_item_id", "order_date_dateorders", "shipping_date_dateorders", "days_for_shipping_real",
    "days_for_shipment_scheduled", "order_item_product_price", "product_price", "order_item_discount",
    "order_profit_per_order", "latitude_src", "longitude_src", "latitude_dest", "longitude_dest",
    "category_name", "customer_segment", "department_name", "market", "order_status", "shipping_mode",
    "customer_country", "product_name", "type", "delivery_status",
]


def order_items(spark: SparkSession, sf_dir: str, *columns: str, customers_first: bool = False) -> DataFrame:
    """The named columns of every order line (default: the raw input columns of the study).

    ``customers_first`` joins customers to orders, which are fewer than lines, before both join the lines. Left joins give
    the same rows either way, in another order, on which models that sample rows depend.
    """
    columns = columns or tuple(RAW_COLUMNS)
    needed: set[str] = set().union(*(_DEFINITIONS[name][0] for name in columns))

    def with_customers(rows: DataFrame) -> DataFrame:
        customer = load(spark, sf_dir, "customer")
        if "nation" in needed:
            nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
            place = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
            customer = customer.join(place, customer.c_nationkey == place.n_nationkey, "left")
        return rows.join(customer, rows.o_custkey == customer.c_custkey, "left")

    def with_orders(rows: DataFrame) -> DataFrame:
        orders = load(spark, sf_dir, "orders")
        if customers_first and "customer" in needed:
            orders = with_customers(orders)
        return rows.join(orders, rows.l_orderkey == orders.o_orderkey, "left")

    def with_part(rows: DataFrame) -> DataFrame:
        part = load(spark, sf_dir, "part")
        return rows.join(part, rows.l_partkey == part.p_partkey, "left")

    def with_supplier(rows: DataFrame) -> DataFrame:
        supplier = load(spark, sf_dir, "supplier")
        return rows.join(supplier, rows.l_suppkey == supplier.s_suppkey, "left")

    joins = {"orders": with_orders, "customer": with_customers, "part": with_part, "supplier": with_supplier}
    order = ("supplier", "part", "orders") if customers_first else ("orders", "customer", "part", "supplier")
    lines = load(spark, sf_dir, "lineitem")
    for table in order:
        if table in needed:
            lines = joins[table](lines)
    return lines.select(*[_column(name) for name in columns])


def binary_predictions(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Scored rows of a two-class model: row_key, y_true, y_pred, prob = [p(on time), p(late)]."""
    base = order_items(
        spark, sf_dir, *dict.fromkeys(
            ["row_key", "late", "order_item_cardprod_id", "supplier_id", "line_number", "order_id", *extra]
        )
    )
    mix = F.col("order_item_cardprod_id") * 31 + F.col("supplier_id") * 17 + F.col("line_number") * 7 + F.col("order_id")
    points = F.pmod(mix, F.lit(1000)) + 300 * F.col("late")
    score = points / F.lit(1300.0)
    return base.select(
        "row_key", F.col("late").alias("y_true"), F.when(points >= 650, 1).otherwise(0).alias("y_pred"),
        F.array(1 - score, score).alias("prob"), *extra,
    )


def _weights() -> list[Column]:
    return [
        (
            1
            + F.pmod(F.col("order_item_cardprod_id") * (k + 3) + F.col("supplier_id"), F.lit(97))
            + F.when(F.col("stability") == k, 40).otherwise(0)
        ).cast("double")
        for k in range(5)
    ]


def class_weights(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Row key, five-class label and one positive integer weight per class."""
    base = order_items(spark, sf_dir, "row_key", "stability", "order_item_cardprod_id", "supplier_id", *extra)
    return base.select("row_key", F.col("stability").alias("y_true"), F.array(*_weights()).alias("weights"), *extra)


def multi_predictions(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Scored rows of a five-class model: row_key, y_true, y_pred, prob (five entries)."""
    base = order_items(spark, sf_dir, "row_key", "stability", "order_item_cardprod_id", "supplier_id", *extra)
    names = [f"w{k}" for k in range(5)]
    rows = base.withColumns(dict(zip(names, _weights())))
    total = sum((F.col(n) for n in names[1:]), F.col("w0"))
    return rows.select(
        "row_key", F.col("stability").alias("y_true"), argmax(F.array(*names)).alias("y_pred"),
        F.array(*[F.col(n) / total for n in names]).alias("prob"), *extra,
    )
