"""Whole plans, plan shapes, streaming use and the registered queries against their SQL."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from latewise import session
from latewise.catalog.modelling import unscaled
from latewise.operators import curves, features
from latewise.operators.models import score
from latewise.operators.split import stratified_split
from latewise.plans.binary import engineered, engineered_table, materialize, prepare_binary
from latewise.plans.five_class import prepare_five_class
from latewise.sources.order_items import binary_predictions, order_items
from latewise.sources.tables import to_xy

# Statements whose Spark side fits nothing costly; tools/check_queries.py covers all of them.
CHECKED = [
    "delay_overview", "merge_dedup", "finance_ratios", "geo_fallback", "order_distinct_items", "label_encode", "one_hot",
    "select_k_best", "class_ratio", "roc_curve", "roc_auc_ovr", "metrics_record", "early_stopping", "prepare_five_class",
    "knn_predict", "shap_summary", "error_cases",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    expected = sorted(repr(row) for row in cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in df.select(*[f"`{n}`" for n in names]).collect()) == expected


def _optimized(spark, sf, name):
    return entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_split_reads_lines_that_were_joined_once(spark, sf):
    assert "Join" not in _optimized(spark, sf, "stratified_split")


def test_split_reads_keys_that_were_numbered_once(spark, sf):
    plan = _optimized(spark, sf, "split_duplicate_keys")
    assert "Join" not in plan and "Window" not in plan


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_prepare_binary_on_training_rows_only(spark, sf):
    prepared = prepare_binary(order_items(spark, sf), fit_on="train", k=10, exclude=("on_time_delivery_0", "on_time_delivery_1", "on_time_delivery_nan"))
    assert len(prepared.features) == 10 and not any(f.startswith("on_time") for f in prepared.features)
    counts = {r["split"]: r["count"] for r in prepared.table.groupBy("split").count().collect()}
    assert counts == {"train": 4800, "val": 600, "test": 600}
    stats = prepared.part("train").agg(*[F.avg(c) for c in prepared.features], *[F.stddev_pop(c) for c in prepared.features]).first()
    assert max(abs(v) for v in stats[:10]) < 1e-9 and max(abs(v - 1) for v in stats[10:]) < 1e-9


def test_five_class_without_key_and_label(spark):
    a = spark.createDataFrame([(float(i % 20), None if i % 4 else 1.0, i % 5) for i in range(200)], "x double, z double, y int")
    prepared = prepare_five_class(a, a, "y")
    assert prepared.table.count() == a.distinct().count()
    with pytest.raises(ValueError, match="missing columns: y"):
        prepare_five_class(a, a.drop("y"), "y")
    # A missing label among the first five columns is filled like them; elsewhere it is an error.
    wide = a.withColumns({"p": F.lit(1), "q": F.lit(2), "r": F.lit(3)}).select("x", "z", "p", "q", "r", "y")
    with pytest.raises(Exception, match="a row has no label"):
        prepare_five_class(wide, wide.withColumn("y", F.lit(None).cast("int")), "y")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_stays_in_the_jvm_and_prunes(spark, sf):
    text = plan(features.geo_features(order_items(spark, sf, "latitude_src", "longitude_src", "latitude_dest", "longitude_dest")))
    assert "Python" not in text and "Pandas" not in text
    assert "l_tax" not in text and "p_partkey" not in text


def test_split_is_a_projection(spark, sf):
    rows = order_items(spark, sf, "row_key", "stability")
    text = plan(stratified_split(rows, "stability", "row_key"))
    assert "Exchange" not in text and "Join" not in text


def test_curve_does_not_gather_scores_in_one_task(spark, sf):
    text = plan(curves.ranked_counts(curves.binary_points(binary_predictions(spark, sf))))
    # Only the cell totals (one row per bucket) may meet in one partition.
    for line in text.splitlines():
        if "SinglePartition" in line:
            assert "score" not in line


def test_projections_and_scoring_run_on_streams(spark, tmp_path):
    from pyspark.ml.classification import DecisionTreeClassifier

    batch = spark.createDataFrame(
        [(float(i), float(i % 3), i % 4, i % 3, i % 2) for i in range(20)],
        "order_item_product_price double, order_item_discount double, days_for_shipping_real int, days_for_shipment_scheduled int, y int",
    ).withColumn("order_profit_per_order", F.lit(1.0))
    batch.write.parquet(str(tmp_path / "in"))
    model = DecisionTreeClassifier(maxDepth=2).fit(to_xy(batch, "y", ["order_item_product_price"]))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    stream = features.finance_features(features.delivery_features(stream))
    scored = score(model, to_xy(stream, "y", ["order_item_product_price"], keep=["profit_margin"]), keep=("profit_margin",))
    query = scored.writeStream.format("memory").queryName("scored").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("scored").count() == 20


def _joined_last(df):
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    return plan.children().apply(1).toString()


def test_customers_join_orders_before_lines(spark, sf):
    wanted = ("row_key", "late", "customer_segment", "customer_country", "product_name", "latitude_src")
    first, last = (order_items(spark, sf, *wanted, customers_first=on) for on in (True, False))
    assert "c_custkey" in _joined_last(first) and "c_custkey" not in _joined_last(last)
    assert first.dtypes == last.dtypes and sorted(map(repr, first.collect())) == sorted(map(repr, last.collect()))


def test_engineered_rows_are_the_same_in_passes(spark, sf):
    raw = order_items(spark, sf)
    # Orders without an id and those with id 0 are one order once filled.
    raw = raw.withColumn("order_id", F.when(F.col("order_id") % 7 == 0, None).when(F.col("order_id") % 7 == 1, 0).otherwise(F.col("order_id")))
    whole, found = engineered(raw), engineered_table(raw, "engineered", pass_bytes=20_000)
    assert found.columns == whole.columns
    assert len({f.rsplit("-", 2)[0] for f in found.inputFiles()}) > 1
    assert sorted(map(repr, found.collect())) == sorted(map(repr, whole.collect()))


def test_shuffle_files_go_with_the_write(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    assert materialize(spark.range(1_000).repartition(3, "id"), "kept").count() == 1_000
    written = {f for f in shuffled() - before if f.endswith(".data")}
    # Counting what was written shuffles one short row; the rows' own shuffle had three partitions for each task.
    assert sum(Path(disk.getFile(f).getPath()).stat().st_size for f in written) < 1_000


def test_unscaled_lines_are_written_once(spark, sf):
    before = len(session._MADE)
    split = unscaled(spark, sf, "late", ["quantity", "tax"])
    assert len(session._MADE) == before + 1
    assert {p: rows.count() for p, rows in split.items()} == {"train": 4800, "val": 600, "test": 600}
