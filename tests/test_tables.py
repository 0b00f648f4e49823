import json
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from latewise.operators import clean, encode, features, profile, select
from latewise.operators.scale import Standardizer
from latewise.operators.split import StratifiedSplit, split_quotas, stratified_split, unique_key
from latewise.session import work_dir
from latewise.sources import tables


def test_read_table_checks_required_columns(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("x,y\n1,a\n2,b\n")
    assert tables.read_table(spark, str(path), "x int, y string", ["x"]).count() == 2
    assert dict(tables.read_table(spark, str(path)).dtypes)["x"] == "int"
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.read_table(spark, str(path), required=["z"])


def test_strict_drop_and_published_list(spark):
    df = spark.createDataFrame([(1, 2, 3)], "order_city int, customer_email int, x int")
    assert clean.drop_columns(df).columns == ["x"]
    assert clean.drop_columns(df, as_published=True).columns == ["order_city", "x"]
    with pytest.raises(ValueError):
        clean.drop_strict(df, ["nope"])


def test_fill_all(spark):
    df = spark.createDataFrame([(None, None, 1.5), (2, "a", None)], "i int, s string, d double")
    assert [tuple(r) for r in clean.fill_all(df).collect()] == [(0, "0", 1.5), (2, "a", 0.0)]


def test_merge_dedup_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, 3)], "x int, y int")
    b = spark.createDataFrame([(3, 2), (5, 1)], "y int, x int")
    got = sorted(map(tuple, clean.merge_dedup(a, b).collect()), key=str)
    assert got == [(1, 5), (1, None), (2, 3)]


def test_given_risk_column_wins(spark):
    df = spark.createDataFrame([(5, 1, 0), (1, 5, 1)], "days_for_shipping_real int, days_for_shipment_scheduled int, late_delivery_risk int")
    assert [r[0] for r in features.delivery_features(df).select("delivery_risk").collect()] == [0, 1]
    assert [r[0] for r in features.delivery_features(df.drop("late_delivery_risk")).select("delivery_risk").collect()] == [1, 0]


def test_distinct_items_without_item_column(spark):
    df = spark.createDataFrame([(1, 7), (1, 8), (1, 8), (None, 3)], "order_id int, order_item_cardprod_id int")
    got = features.order_distinct_items(df).select("order_num_distinct_items").collect()
    assert sorted(r[0] for r in got) == [1, 2, 2, 2]
    assert features.order_distinct_items(df.select("order_id")).first()["order_num_distinct_items"] == 1


def test_label_order_is_code_point_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("É",), ("Z",), ("a",)], "s string")
    expected = [2, 1, 3, 0, 1]
    for limit in (100_000, 0):
        coded = encode.LabelEncoder.fit(df.withColumn("k", F.col("s")), ["s"], max_labels=limit).apply(df.withColumn("k", F.col("s")))
        assert {r["k"]: r["s"] for r in coded.collect()} == dict(zip(["b", "a", "É", "Z", "a"], expected))


def test_unseen_label_gets_next_code(spark):
    encoder = encode.LabelEncoder.fit(spark.createDataFrame([("a",), ("b",)], "s string"), ["s"], unseen="keep")
    assert encoder.apply(spark.createDataFrame([("c",)], "s string")).first()["s"] == 2


def test_one_hot_has_a_null_column(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "type string")
    got = encode.one_hot(df)
    assert got.columns == ["type_x", "type_y", "type_nan"]
    assert [tuple(r) for r in got.collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    with pytest.raises(ValueError, match="low-cardinality"):
        encode.OneHotEncoder.fit(df, ["type"], max_levels=1)


def test_population_statistics(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (6.0, 5.0)], "x double, c double")
    assert select.variance_filter(df, ["x"], threshold=4) == []
    assert select.variance_filter(df, ["x", "c"], threshold=3.4) == ["x"]
    scaled = Standardizer.fit(df, ["x", "c"]).apply(df).collect()
    assert scaled[0]["x"] == pytest.approx(-1.0690, abs=1e-4) and {r["c"] for r in scaled} == {0.0}
    values = np.array([r["x"] for r in scaled])
    assert values.mean() == pytest.approx(0) and values.std() == pytest.approx(1)


def test_anova_against_direct_formula(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(1e6, 1, 300), rng.integers(0, 3, 300)
    df = spark.createDataFrame([(float(a), 1.0, float(b), int(b)) for a, b in zip(x, y)], "x double, c double, leak double, y int")
    got = {r["column"]: r["f"] for r in select.anova_f(df, ["x", "c", "leak"], "y").collect()}
    groups = [x[y == k] for k in range(3)]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert got["x"] == pytest.approx(between / 2 / (within / 297), rel=1e-6)
    assert np.isnan(got["c"]) and np.isinf(got["leak"])
    assert select.select_k_best(df, ["x", "c", "leak"], "y", 2) == ["x", "leak"]


def test_equal_scores_prefer_the_later_column(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 7) * 3.3, i % 2) for i in range(50)], "a double, b double, y int")
    assert select.select_k_best(df, ["a", "b"], "y", 1) == ["b"]


@pytest.mark.parametrize("counts", [{0: 9000}, {0: 5, 1: 7, 2: 88}, {0: 43051, 1: 56949}, {0: 1, 1: 1}])
def test_split_quotas_add_up(counts):
    quotas, n = split_quotas(counts), sum(counts.values())
    n_test = int(np.ceil(0.1 * n))
    assert sum(t for t, _ in quotas.values()) == n_test
    assert sum(v for _, v in quotas.values()) == int(np.ceil(0.1 / 0.9 * (n - n_test)))
    for c, (t, v) in quotas.items():
        assert 0 <= t and 0 <= v and t + v <= counts[c]
        assert abs(t - 0.1 * counts[c]) <= 1.5


def test_split_is_exact_and_does_not_depend_on_layout(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("y"))
    a = stratified_split(df, "y", "k")
    b = stratified_split(df.repartition(7).orderBy(F.rand(3)), "y", "k")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    counts = {(r["y"], r["split"]): r["count"] for r in a.groupBy("y", "split").count().collect()}
    quotas = split_quotas({0: 2000, 1: 1000})
    for y, (t, v) in quotas.items():
        assert (counts[y, "test"], counts[y, "val"]) == (t, v)


def test_split_refuses_a_key_as_label(spark):
    df = spark.range(1500).select(F.col("id").cast("string").alias("k"), F.col("id").alias("y"))
    with pytest.raises(ValueError, match="not a class label"):
        StratifiedSplit.fit(df, "y", "k")


def test_splits_and_reports_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "train"), ("b", 2, "test")], "k string, x int, split string")
    tables.write_splits(df, str(tmp_path / "s"))
    back = tables.read_split(spark, str(tmp_path / "s"), "test", schema="k string, x int, split string")
    assert [tuple(r) for r in back.collect()] == [("b", 2, "test")]
    report = spark.createDataFrame([("0", 0.5, 3), ("accuracy", None, 3)], "row string, f1 double, support long")
    tables.write_report(report, str(tmp_path / "t"), fmt="text")
    text = "".join(p.read_text() for p in Path(tmp_path / "t").glob("*.txt"))
    assert "0.5000" in text and "accuracy" in text
    tables.write_results(report, str(tmp_path / "j"))
    lines = "".join(p.read_text() for p in Path(tmp_path / "j").glob("*.json")).splitlines()
    assert json.loads(lines[0])["f1"] == 0.5


def test_profile_and_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "x int, s string")
    assert tuple(profile.profile(df).first()) == (3, 2, 1, 1)
    assert [tuple(r) for r in profile.missing_report(df).collect()] == [("s", 1)]
    assert [tuple(r) for r in profile.value_counts(df, "s").collect()] == [("a", 2), (None, 1)]


def test_work_dir_uses_the_shared_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    one, two = work_dir(spark), work_dir(spark)
    assert one != two and (base is None or one.startswith(base.rstrip("/") + "/"))


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a\n1,2\n")
    got = tables.read_table(spark, str(tmp_path / "t.csv"), "a int, b int").collect()
    assert [tuple(r) for r in got] == [(2, 1)]
    with pytest.raises(ValueError, match="label"):
        tables.read_table(spark, str(tmp_path / "t.csv"), "a int, b int, label int", required=["label"])


def test_large_columns_treat_unseen_values_like_small_ones(spark):
    known = spark.createDataFrame([("a",), ("b",)], "s string")
    new = spark.createDataFrame([("b",), ("z",)], "s string")
    for limit in (0, 1000):
        keep = encode.LabelEncoder.fit(known, ["s"], max_labels=limit, unseen="keep")
        assert [r.s for r in keep.apply(new).collect()] == [1, 2]
        with pytest.raises(Exception, match="(?i)unseen"):
            encode.LabelEncoder.fit(known, ["s"], max_labels=limit).apply(new).collect()


def test_split_refuses_keys_that_cannot_decide(spark):
    empty = spark.createDataFrame([(None, i % 2) for i in range(100)], "k string, y int")
    with pytest.raises(ValueError, match="no k"):
        stratified_split(empty, "y", "k")
    repeated = spark.createDataFrame([(f"k{i % 5}", i % 2) for i in range(100)], "k string, y int")
    with pytest.raises(ValueError, match="repeats"):
        stratified_split(repeated, "y", "k")
    for rows in (empty, repeated):
        own = unique_key(rows, "own")
        assert own.select("own").distinct().count() == 100
        parts = {r[0]: r[1] for r in stratified_split(own, "y", "own").groupBy("split").count().collect()}
        assert parts == {"train": 80, "val": 10, "test": 10}


def test_keys_of_rows_tell_nulls_and_separators_apart(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x"), ("~", "x")], "p string, q string")
    assert unique_key(rows, "k").select("k").distinct().count() == 5


def test_stamped_names_differ_by_time():
    assert tables.stamped("a/results/", datetime(2024, 5, 6, 7, 8, 9)) == "a/results_20240506_070809"


def test_quotas_end_in_ever_longer_prefixes(spark):
    df = spark.range(3_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).cast("int").alias("y"))
    plain = StratifiedSplit.fit(df, "y", "k")
    # One digit counts all rows into sixteen cells, so every quota is followed through longer prefixes.
    short = StratifiedSplit.fit(df, "y", "k", prefix=1, max_cell=2)
    assert short.limits == plain.limits and len(plain.limits) == 3
    assert StratifiedSplit.fit(df, "y", "k", prefix=1, max_cell=1).limits == plain.limits
    # A third of all rows with one key: the cell cannot get smaller, and the key is an error where a part ends in it.
    same = df.withColumn("k", F.when(F.col("y") == 0, "same").otherwise(F.col("k")))
    with pytest.raises(ValueError, match="repeats where a part"):
        StratifiedSplit.fit(same, "y", "k", prefix=1, max_cell=10)


def test_null_totals(spark):
    from latewise.operators.clean import null_totals

    df = spark.createDataFrame([(None, 1, None, 2, None, None, "x"), (1, None, "a", 2, 0, 3, None)],
                               "a int, b int, c string, d int, y int, e int, f string")
    got = {r["part"]: r["n_null"] for r in null_totals(df, "y").collect()}
    assert got == {"leading": 4, "numeric": 1}
    assert {r["n_null"] for r in null_totals(df.limit(0), "y").collect()} == {0}
