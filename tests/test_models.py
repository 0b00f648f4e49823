import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from itertools import combinations
from math import factorial
from pathlib import Path

from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.sql import functions as F

from latewise import session
from latewise.operators import explain as X
from latewise.operators.models import DecisionTree, ExtraTrees, GradientBoosting, ImportanceForest, NearestNeighbours, fit_mlp, registry, score
from latewise.operators.losses import cross_entropy
from latewise.operators.metrics import confusion, summary_metrics
from latewise.operators.models import boosting as B
from latewise.operators.models.mlp import judged
from latewise.operators.tree_shap import leaves_of, tree_shap
from latewise.plans.experiment import run_ablation, run_models
from latewise.sources.tables import load_model, save_model, to_xy


def blobs(spark, n=300, classes=2, d=4, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, d)) + 1.5 * y[:, None] * (np.arange(d) < 2)
    rows = [(str(i), *map(float, x[i]), int(y[i])) for i in range(n)]
    names = [f"x{j}" for j in range(d)]
    return spark.createDataFrame(rows, "row_key string, " + ", ".join(f"{c} double" for c in names) + ", y int"), names, x, y


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_knn_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(240, 3)), 1)
    # A third of all training rows are copies of one point.
    x[:80] = x[0]
    y = rng.integers(0, 3, 240)
    frame = spark.createDataFrame([(i, list(map(float, x[i])), int(y[i])) for i in range(240)], "id long, features array<double>, label int")
    train, query = frame.filter("id < 180"), frame.filter("id >= 180 OR id < 5")
    got = NearestNeighbours(key="id", k=10, leaf_rows=20, block_rows=block_rows).fit(train).neighbours(query)
    found = {}
    for r in got.collect():
        found.setdefault(r["key"], []).append((r["distance"], r["train_key"]))
    for i in [*range(5), *range(180, 240)]:
        d = np.sqrt(((x[:180] - x[i]) ** 2).sum(axis=1))
        expected = sorted(zip(d, range(180)))[:10]
        assert [t for _, t in sorted(found[i])] == [t for _, t in expected]


def test_knn_visits_grow_slower_than_the_table(spark):
    """Four times the rows, four times the leaves: a query's share of visited leaves falls."""
    rng = np.random.default_rng(5)
    shares, visited = [], []
    for n in (2_000, 8_000):
        x = rng.uniform(size=(n + 100, 2))
        frame = spark.createDataFrame([(i, list(map(float, x[i])), 0) for i in range(n + 100)], "id long, features array<double>, label int")
        model = NearestNeighbours(key="id", k=5, leaf_rows=40).fit(frame.filter(F.col("id") < n))
        bounded, _ = model.bounded(frame.filter(F.col("id") >= n))
        visited.append(model.visits(bounded).count() / 100)
        shares.append(visited[-1] / (model.tree.count > 0).sum())
        assert model.tree.count.sum() == n
    assert visited[1] < 1.5 * visited[0] and shares[1] < 0.5 * shares[0]


def test_knn_with_few_rows_and_empty_leaves(spark):
    rows = [(i, [float(i % 3)], i % 2) for i in range(30)]
    frame = spark.createDataFrame(rows, "id long, features array<double>, label int")
    # Copies make leaves without rows; fewer rows than k give them all.
    model = NearestNeighbours(key="id", k=40, leaf_rows=2).fit(frame)
    assert model.neighbours(frame.filter("id < 2")).count() == 60
    assert (model.tree.count == 0).any()
    assert model.neighbours(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no training rows"):
        NearestNeighbours(key="id").fit(frame.limit(0))


def test_knn_memory_is_bounded_where_all_rows_tie():
    import tracemalloc

    from latewise.operators.models.knn import MetricTree, _block_neighbours, _visit_batches

    n, x = 1_000, np.ones(64)
    query = pd.DataFrame({"key": range(n), "x": [x] * n})
    train = pd.DataFrame({"key": [f"k{i:04d}" for i in reversed(range(n))], "x": [x] * n, "label": range(n)})
    tracemalloc.start()
    found = _block_neighbours(query, train, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6  # 1.6 GB where the coordinates of all pairs were held at once
    assert len(found) == 3 * n and set(found["train_key"]) == {"k0000", "k0001", "k0002"} and set(found["label"]) == {999, 998, 997}

    pivots = np.arange(300.0)[:, None]
    leaves, balls = np.full(300, 1), np.full(18, 300.0)
    tree = MetricTree.over(pivots)
    tree = MetricTree(tree.outer, tree.inner, tree.begin, leaves, 0 * leaves, 0 * leaves, balls)
    batch = pd.DataFrame({"key": range(n), "x": [np.zeros(1)] * n, "leaf": 7, "bound": np.inf})
    parts = list(_visit_batches(tree, batch))
    assert max(map(len, parts)) <= 16_384 and len(parts) > 1  # one frame of 299,000 rows before
    visited = pd.concat(parts)
    assert len(visited) == 299 * n and not visited.duplicated(["key", "leaf"]).any() and 7 not in set(visited["leaf"])


def test_knn_votes(spark):
    rows = [(0, [0.0], 1), (1, [1.0], 0), (2, [9.0], 1)]
    frame = spark.createDataFrame(rows, "id long, features array<double>, label int")
    pred = NearestNeighbours(key="id", k=2).fit(frame).predict(frame.filter("id = 0")).first()
    assert pred["prob"] == [0.5, 0.5] and pred["y_pred"] == 0


def test_extra_trees(spark):
    df, names, _, y = blobs(spark, classes=3)
    xy = to_xy(df, "y", names, keep=["row_key"])
    model = ExtraTrees(n_trees=20, max_depth=4, seed=1).fit(xy)
    again = ExtraTrees(n_trees=20, max_depth=4, seed=1).fit(xy.repartition(5))
    assert np.array_equal(model.forest.threshold, again.forest.threshold)
    pred = score(model, xy).collect()
    assert all(sum(r["prob"]) == pytest.approx(1) for r in pred)
    assert np.mean([r["y_true"] == r["y_pred"] for r in pred]) > np.bincount(y).max() / len(y) + 0.1
    # Children of a split node share its rows.
    forest = model.forest
    t, i = np.nonzero(forest.feature >= 0)
    assert np.allclose(forest.counts[t, 2 * i + 1] + forest.counts[t, 2 * i + 2], forest.counts[t, i])


@pytest.mark.parametrize("n_keys", [7, 900, 70_000, 5_000_000])
def test_importance_forest_counts_cells(n_keys):
    """Counted in place or sorted by radix, up to more than two times sixteen bits of (node, bin)."""
    from latewise.operators.models import forest as R

    rng = np.random.default_rng(n_keys)
    key, classes, weight = rng.integers(0, n_keys, 700), rng.integers(0, 3, 700), rng.integers(1, 4, 700).astype(float)
    key[:300] = n_keys - 1
    found, sums = R._cells(key, classes, weight, n_keys, 3)
    assert found.tolist() == np.unique(key).tolist()
    assert sums.tolist() == [[weight[(key == k) & (classes == c)].sum() for c in range(3)] for k in found]


def test_extra_trees_deal_out_the_rows_of_a_block():
    """The rows of every open node, without a matrix of rows x trees."""
    from latewise.operators.models import extra_trees as E

    rng = np.random.default_rng(4)
    x, y = np.round(rng.normal(size=(500, 3)), 1), rng.integers(0, 3, 500).astype(np.int32)
    feature = np.array([[0, 1, 2, -1, 2, 0, 1] + [-1] * 8, [2, -1, 0, -1, -1, 1, 1] + [-1] * 8])
    threshold = np.round(rng.normal(size=feature.shape) / 4, 1)
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(y)], ["x", "y"])
    blocks = list(E._blocks(iter([batch.slice(0, 90), batch.slice(90)]), 128))
    assert [len(labels) for _, labels in blocks] == [218, 128, 128, 26] and all((np.diff(labels) >= 0).all() for _, labels in blocks)
    for level in range(4):
        wanted = np.arange(2**level) % 3 != 1
        for columns, labels in blocks:
            part = np.stack(columns, axis=1)
            node = E.Forest(feature, threshold, None).route(part, level) - (2**level - 1)
            for t in range(2):
                got = {i: np.arange(len(labels))[rows].tolist() for i, rows in E._open_rows(columns, feature[t], threshold[t], level, wanted)}
                assert got == {i: np.flatnonzero(node[:, t] == i).tolist() for i in np.flatnonzero(wanted) if (node[:, t] == i).any()}
    with pytest.raises(ValueError):
        list(E._blocks(iter([pa.RecordBatch.from_arrays([pa.array([[1.0], [1.0, 2.0]]), pa.array([0, 1], pa.int32())], ["x", "y"])])))


def test_extra_trees_send_one_row_a_tree(spark):
    from latewise.operators.models import extra_trees as E

    df, names, x, _ = blobs(spark, classes=3)
    xy = to_xy(df, "y", names)
    rows = xy.select(E._vector(xy, "features").alias("x"), F.col("label").cast("int").alias("y")).repartition(6)
    forest = E.Forest(np.full((9, 7), -1), np.zeros((9, 7)), np.zeros((9, 7, 3)))
    chosen, open_nodes = np.tile(np.arange(2), (9, 1, 1)), np.ones((9, 1), dtype=bool)
    low, high = ExtraTrees(n_trees=9)._ranges(rows, forest, 0, chosen, open_nodes)
    assert np.allclose(low[:, 0], x[:, :2].min(axis=0)) and np.allclose(high[:, 0], x[:, :2].max(axis=0))
    for seen in (open_nodes[:, 0], np.arange(9) < 4, np.zeros(9, dtype=bool)):
        assert len(E._packed(low.ravel(), high.ravel(), chosen.shape, seen)) == seen.sum()


def test_one_vs_rest_has_probabilities(spark):
    df, names, _, _ = blobs(spark, n=150, classes=3)
    xy = to_xy(df, "y", names)
    model = OneVsRest(classifier=GBTClassifier(maxIter=3, maxDepth=2, seed=1)).fit(xy)
    pred = score(model, xy).collect()
    assert all(len(r["prob"]) == 3 and sum(r["prob"]) == pytest.approx(1) for r in pred)


def test_logistic_regression_has_the_penalty_of_the_study(spark):
    df, names, x, y = blobs(spark)
    model = registry(len(y), 2)["LogisticRegression"].fit(to_xy(df, "y", names))
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    # Gradient of sum of losses + |w|^2 / 2 vanishes at the optimum.
    assert np.abs(x.T @ (p - y) + w).max() < 0.05 and abs((p - y).sum()) < 0.05


def test_mlp_keeps_the_best_round(spark):
    df, names, _, _ = blobs(spark)
    xy = to_xy(df, "y", names)
    model, history = fit_mlp(xy, xy, len(names), 2, hidden=[4], rounds=4, patience=2, steps=5)
    rows = history.collect()
    assert 1 <= len(rows) <= 4 and max(r["val_f1"] for r in rows) > 0.6
    # Train and validation rows are the same here; the metrics are those of the library's own operators.
    assert all(r["train_loss"] == pytest.approx(r["val_loss"]) for r in rows) and rows[-1]["val_loss"] < rows[0]["val_loss"]
    pred = score(model, xy)
    loss, accuracy, f1 = judged(model, xy)
    known = summary_metrics(confusion(pred)).first()
    assert (accuracy, f1) == pytest.approx((known["accuracy"], known["macro_f1"]))
    assert loss == pytest.approx(cross_entropy(pred).first()["log_loss"])
    assert model.numClasses == 2


def test_test_rows_are_scored_once(spark):
    df, names, _, _ = blobs(spark, n=60)
    xy = to_xy(df, "y", names)
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        def fit(self, df):
            return self

        def transform(self, df):
            @F.pandas_udf("array<double>")
            def probability(x):
                seen.add(len(x))
                return x.map(lambda v: [0.4, 0.6])

            scored = df.withColumn("probability", probability(F.col("label")))
            return scored.withColumn("prediction", F.lit(1.0))

    run_models({"m": Counting()}, xy, xy, 2, on_error="raise").collect()
    assert seen.value == 60


def test_run_models_records_failures(spark):
    df, names, _, _ = blobs(spark)
    xy = to_xy(df, "y", names)
    models = {"tree": DecisionTreeClassifier(maxDepth=2), "broken": DecisionTreeClassifier(featuresCol="nope")}
    got = {r["model"]: r for r in run_models(models, xy, xy, 2).collect()}
    assert got["tree"]["status"] == "ok" and got["tree"]["accuracy"] > 0.6
    assert got["broken"]["status"] == "failed" and "nope" in got["broken"]["error"] and got["broken"]["accuracy"] is None
    with pytest.raises(ValueError, match="unknown models: other"):
        run_models(models, xy, xy, 2, ["other"])


def test_ablation_variants(spark):
    df, names, _, _ = blobs(spark)
    table = df.withColumn("split", F.when(F.col("row_key").cast("int") < 200, "train").otherwise("test"))
    got = run_ablation(lambda: DecisionTreeClassifier(maxDepth=2), table, names, {"signal": names[:2]}, "y").collect()
    assert [r["variant"] for r in got] == ["full", "no_signal"] and got[0]["f1"] > got[1]["f1"]
    with pytest.raises(ValueError, match="unknown variants"):
        run_ablation(lambda: None, table, names, {}, "y", names=["no_x"])


def test_expected_gradients_add_up(spark):
    df, names, x, _ = blobs(spark, n=40)
    model = X.SoftmaxModel(names, np.array([[0.0] * 4, [0.4, -0.3, 0.2, 0.1], [-0.2, 0.5, 0.0, 0.3]]), np.array([0.1, 0.0, -0.1]))
    background = X.background_sample(df, "row_key", names, 20)
    rows = X.expected_gradients(df, background, model, steps=50).table.collect()
    z = x @ model.weights.T + model.intercepts
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert len(rows) == 120
    for r in rows:
        assert sum(r["shap"]) + r["base"] == pytest.approx(p[int(r["row_key"]), r["class"]], abs=1e-3)
    with pytest.raises(ValueError):
        X.background_sample(df, "row_key", names, 101)


def test_linear_shap_is_exact(spark):
    df, names, x, _ = blobs(spark, n=30)
    w, b = [0.4, -0.3, 0.2, 0.1], 0.7
    for r in X.linear_shap(df, df, names, w, b).table.collect():
        assert sum(r["shap"]) + r["base"] == pytest.approx(float(x[int(r["row_key"])] @ w + b))


def test_permutation_shap_moves_no_copies(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    names = ["a", "b"]
    frame = spark.createDataFrame([(f"k{i // 2}", float(a), float(b), int(a > 0)) for i, (a, b) in enumerate(x)], "row_key string, a double, b double, label int")
    model = DecisionTreeClassifier(maxDepth=2, seed=1).fit(to_xy(frame, "label", names))
    background = x[:5]
    # A row that repeats is explained once, rows that share a key each for itself.
    explained = X.permutation_shap(model, frame.unionByName(frame), background, names)
    plan = explained.table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    rows = explained.table.collect()
    assert len(rows) == 160
    for r in rows:
        p = [np.mean([(v > 0) == r["class"] for v in part]) for part in (background[:, 0], [r["values"][0]])]
        assert r["base"] == pytest.approx(p[0]) and r["shap"][0] == pytest.approx(p[1] - p[0]) and r["shap"][1] == 0


@pytest.mark.parametrize("kind", ["own", "tree", "forest"])
def test_permutations_of_trees_equal_copies(spark, monkeypatch, kind):
    df, names, x, _ = blobs(spark, n=120, classes=3, d=5)
    xy = to_xy(df, "y", names, keep=["row_key"])
    model = {"own": DecisionTree(max_depth=4), "tree": DecisionTreeClassifier(maxDepth=4, seed=1),
             "forest": RandomForestClassifier(numTrees=3, maxDepth=4, seed=1)}[kind].fit(xy)
    # Values on a threshold go left, infinite ones to an end.
    cuts = [b for leaf in leaves_of(model, df) for b in (*leaf.low, *leaf.high)]
    odd = [("odd", *([float(c)] * 5), 0) for c in sorted(set(cuts))]
    some = df.limit(20).unionByName(spark.createDataFrame(odd, df.schema))
    looked = X.permutation_shap(model, some, x[:7], names, n_permutations=4)
    plan = looked.table._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    monkeypatch.setattr("latewise.operators.tree_shap.leaves_if_tree", lambda *_: None)
    copied = X.permutation_shap(model, some, x[:7], names, n_permutations=4)
    assert looked.table.dtypes == copied.table.dtypes
    got, want = ({(r["row_key"], tuple(r["values"]), r["class"]): [*r["shap"], r["base"]] for r in t.table.collect()} for t in (looked, copied))
    assert got.keys() == want.keys() and len(got) == 3 * (20 + len(odd))
    for at in want:
        assert got[at] == pytest.approx(want[at], abs=1e-12)


def test_permutation_shap_adds_up(spark):
    df, names, _, _ = blobs(spark)
    xy = to_xy(df, "y", names, keep=["row_key"])
    model = LogisticRegression().fit(xy)
    background = X.background_sample(df, "row_key", names, 5)
    sample = df.limit(6)
    truth = {r["row_key"]: r["prob"] for r in score(model, to_xy(sample, "y", names, keep=["row_key"]), keep=("row_key",)).collect()}
    rows = X.permutation_shap(model, sample, background, names).table.collect()
    assert len(rows) == 12
    for r in rows:
        assert sum(r["shap"]) + r["base"] == pytest.approx(truth[r["row_key"]][r["class"]])


def test_waterfall_keeps_the_total(spark):
    df, names, _, _ = blobs(spark, n=5)
    explained = X.linear_shap(df, df, names, [0.4, -0.3, 0.2, 0.1], 0.0)
    bars = X.shap_waterfall(explained, max_display=3).collect()
    force = {r["row_key"]: r for r in X.shap_force(explained).collect()}
    for key in force:
        mine = [r for r in bars if r["row_key"] == key]
        assert len(mine) == 3 and mine[-1]["feature"] == "2 other features"
        assert sum(r["shap"] for r in mine) + mine[0]["base"] == pytest.approx(force[key]["output"])


def grown(x, y, depth, classes):
    """A Gini tree by trying every cut of every node: {node: (feature, threshold, counts)}."""
    nodes = {}

    def purity(labels):
        counts = np.bincount(labels, minlength=classes).astype(float)
        return (counts**2).sum() / counts.sum()

    def grow(rows, node, level):
        counts = tuple(np.bincount(y[rows], minlength=classes).tolist())
        nodes[node] = (-1, 0.0, counts)
        if level == depth or sum(c > 0 for c in counts) < 2:
            return
        best = None
        for j in range(x.shape[1]):
            values = np.unique(x[rows, j])
            for v, later in zip(values, values[1:]):
                left, right = rows[x[rows, j] <= v], rows[x[rows, j] > v]
                worth = (purity(y[left]) + purity(y[right]), -j, -v)
                if best is None or worth > best[0]:
                    best = (worth, j, (v + later) / 2, left, right)
        if best:
            nodes[node] = (best[1], best[2], counts)
            grow(best[3], 2 * node + 1, level + 1)
            grow(best[4], 2 * node + 2, level + 1)

    grow(np.arange(len(y)), 0, 0)
    return nodes


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_decision_tree_equals_trying_every_cut(spark, buckets):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(220, 3)), 1)
    x[:, 2] = rng.integers(0, 2, 220)
    y = (x[:, 0] + rng.normal(size=220) > 0).astype(int) + (x[:, 1] > 0.7)
    frame = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], "features array<double>, label int")
    model = DecisionTree(max_depth=4, buckets=buckets).fit(frame)
    got = {n.node: (n.feature, n.threshold, n.counts) for n in model.nodes}
    want = grown(x, y, 4, 3)
    assert got == {i: (f, pytest.approx(t), c) for i, (f, t, c) in want.items()}
    rows = model.transform(frame).collect()
    for r in rows:
        node = 0
        while want[node][0] >= 0:
            node = 2 * node + 1 + (r["features"][want[node][0]] > want[node][1])
        share = np.array(want[node][2]) / sum(want[node][2])
        assert r["probability"] == pytest.approx(share.tolist()) and r["prediction"] == share.argmax()
    # One class, one value, no rows.
    assert len(DecisionTree().fit(frame.filter("label = 0")).nodes) == 1
    same = frame.select(F.array(F.lit(1.0)).alias("features"), "label")
    assert len(DecisionTree().fit(same).nodes) == 1
    with pytest.raises(ValueError, match="no training rows"):
        DecisionTree().fit(frame.limit(0))


@pytest.mark.parametrize("classes", [2, 4])
def test_bounds_of_buckets_rule_out_no_best_cut(classes):
    from latewise.operators.models.decision_tree import open_buckets, purities

    rng = np.random.default_rng(classes)
    for _ in range(200):
        y = rng.integers(0, classes, 60)
        bucket = np.sort(rng.integers(0, 8, 60))
        hist = np.zeros((9, classes), dtype=np.int64)
        np.add.at(hist, (bucket, y), 1)
        total = hist.sum(axis=0)
        left = np.cumsum(np.eye(classes, dtype=np.int64)[y], axis=0)[:-1]
        worth = purities(left, total)
        _, kept, bound, start = open_buckets(hist, np.ones(9, dtype=bool))
        at = int(worth.argmax())
        assert bucket[at] in kept and bound[list(kept).index(bucket[at])] >= worth[at] - 1e-9
        assert (start == np.array([hist[:b].sum(axis=0) for b in kept])).all()


def test_decision_tree_moves_few_values_where_columns_have_many(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 2))
    y = (x[:, 0] + 0.2 * rng.normal(size=4000) > 0).astype(int)
    frame = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], "features array<double>, label int")
    moved = []
    picked = DecisionTree._values
    monkeypatch.setattr(DecisionTree, "_values", staticmethod(lambda *a: moved.append(picked(*a).count()) or picked(*a)))
    model = DecisionTree(max_depth=2, buckets=64).fit(frame)
    want = grown(x, y, 2, 2)
    assert {n.node: (n.feature, n.threshold, n.counts) for n in model.nodes} == {i: (f, pytest.approx(t), c) for i, (f, t, c) in want.items()}
    assert 0 < sum(moved) < 2 * x.size / 4


def levels_frame(spark, n=400, classes=2, seed=9):
    """Few distinct values, so bins are exact."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(n, 4)).astype(float)
    y = np.minimum(classes - 1, ((x[:, 0] + x[:, 1] * (x[:, 2] > 5) + rng.normal(size=n) * 2) / 24 * classes).clip(0).astype(int))
    rows = [(str(i), list(map(float, x[i])), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_key string, features array<double>, label int"), x, y


def second_order(x, g, h, depth, lam, min_hess, max_leaves=None):
    """Leaf value of every row in a tree that tries every cut; best-first if ``max_leaves`` is given."""
    def best(rows):
        found = (1e-6, None, None)
        for j in range(x.shape[1]):
            for v in np.unique(x[rows, j])[:-1]:
                left = rows[x[rows, j] <= v]
                right = rows[x[rows, j] > v]
                if min(h[left].sum(), h[right].sum()) < min_hess:
                    continue
                gain = sum(s * g[part].sum() ** 2 / (h[part].sum() + lam) for s, part in ((1, left), (1, right), (-1, rows)))
                if gain > found[0] + 1e-9:
                    found = (gain, left, right)
        return found

    leaves, front = [], [(np.arange(len(g)), 0)]
    done = 1
    while front:
        scored = [(best(rows) if level < depth else (0, None, None), rows, level) for rows, level in front]
        splits = [s for s in scored if s[0][1] is not None]
        leaves += [s[1] for s in scored if s[0][1] is None]
        if max_leaves is not None and splits:
            splits.sort(key=lambda s: -s[0][0])
            if done >= max_leaves:
                leaves += [s[1] for s in splits]
                break
            front = [(s[1], s[2]) for s in splits[1:]]
            splits = splits[:1]
        else:
            front = []
        for (_, left, right), _, level in splits:
            front += [(left, level + 1), (right, level + 1)]
            done += 1
    value = np.zeros(len(g))
    for rows in leaves:
        value[rows] = -g[rows].sum() / (h[rows].sum() + lam)
    return value


@pytest.mark.parametrize("max_leaves", [None, 4, 6])
def test_boosting_equals_brute_force(spark, max_leaves):
    frame, x, y = levels_frame(spark)
    model = GradientBoosting(
        n_trees=3, max_depth=3, learning_rate=0.3, row_share=1.0, column_share=1.0, min_hess=0.5, max_leaves=max_leaves, rewrite=2
    ).fit(frame)
    margin = np.zeros(len(y))
    for _ in range(3):
        p = 1 / (1 + np.exp(-margin))
        margin += 0.3 * second_order(x, p - y, p * (1 - p), 3, 1.0, 0.5, max_leaves)
    assert model.margins(x)[:, 0] == pytest.approx(margin, abs=1e-5)
    for tree in (t for one_round in model.trees for t in one_round):
        used = tree.hess > 0
        assert tree.value[used] == pytest.approx(-0.3 * tree.grad[used] / (tree.hess[used] + 1.0))
        if max_leaves:
            assert (tree.feature >= 0).sum() + 1 <= max_leaves


def test_boosting_of_five_classes(spark):
    frame, x, y = levels_frame(spark, n=600, classes=5)
    settings = GradientBoosting(n_trees=8, max_depth=3, learning_rate=0.3, n_classes=5, key="row_key", rewrite=3)
    model = settings.fit(frame)
    again = settings.fit(frame.repartition(7))
    assert np.array_equal(model.margins(x), again.margins(x))  # whatever the partitions
    pred = score(model, frame, keep=("row_key",)).collect()
    assert all(len(r["prob"]) == 5 and sum(r["prob"]) == pytest.approx(1) for r in pred)
    assert np.mean([r["y_true"] == r["y_pred"] for r in pred]) > np.bincount(y).max() / len(y) + 0.15
    # The first round of a softmax: p - y, and twice p (1 - p).
    g, h = B.gradients(np.zeros((2, 5)), np.array([0, 4]))
    assert g[0] / B.SCALE == pytest.approx([-0.8, 0.2, 0.2, 0.2, 0.2], abs=1e-6) and h[1] / B.SCALE == pytest.approx([0.32] * 5, abs=1e-6)


def test_boosting_draws_rows_and_columns(spark):
    frame, x, _ = levels_frame(spark)
    model = GradientBoosting(n_trees=6, max_depth=1, row_share=0.5, column_share=0.5, key="row_key").fit(frame)
    seen = [t[0].rows[0] for t in model.trees]
    assert len(set(seen)) > 1 and all(0.35 * 400 < n < 0.65 * 400 for n in seen)
    with pytest.raises(ValueError, match="no training rows"):
        GradientBoosting().fit(frame.limit(0))


def test_own_models_survive_saving(spark, tmp_path):
    frame, _, _ = levels_frame(spark, n=120, classes=3)
    makers = {
        "tree": DecisionTree(max_depth=3), "extra": ExtraTrees(n_trees=5, max_depth=3),
        "boost": GradientBoosting(n_trees=2, max_depth=2, n_classes=3), "near": NearestNeighbours(key="row_key", k=3, leaf_rows=16),
    }
    for name, maker in makers.items():
        model = maker.fit(frame)
        save_model(model, str(tmp_path / name))
        loaded = load_model(spark, str(tmp_path / name))
        before, after = (
            sorted((r["row_key"], tuple(r["prob"]), r["y_pred"]) for r in score(m, frame, keep=("row_key",)).collect())
            for m in (model, loaded)
        )
        assert before == after, name


def test_importance_of_a_full_tree_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 3)), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=300) > 0).astype(int) + (x[:, 2] > 1)
    frame = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], "features array<double>, label int")
    want = np.zeros(3)
    nodes = grown(x, y, 60, 3)

    def purity(counts):
        return sum(c * c for c in counts) / sum(counts)

    for i, (feature, _, counts) in nodes.items():
        if feature >= 0:
            want[feature] += purity(nodes[2 * i + 1][2]) + purity(nodes[2 * i + 2][2]) - purity(counts)
    whole = ImportanceForest(n_trees=1, n_candidates=3, bootstrap=False, max_bins=512)
    assert whole.importances(frame) == pytest.approx(want / want.sum(), rel=1e-9)
    # Large nodes are split by jobs, the rest is handed off; several jobs a level.
    for rows in (120, 20):
        dealt = ImportanceForest(n_trees=1, n_candidates=3, bootstrap=False, max_bins=512, task_rows=rows, block_rows=37, job_nodes=2)
        assert dealt.importances(frame.repartition(3)) == pytest.approx(want / want.sum(), rel=1e-9)


def test_importance_finds_the_columns_that_matter(spark):
    df, names, _, y = blobs(spark, n=500)
    rows = to_xy(df, "y", names)
    got = ImportanceForest(n_trees=12, task_rows=200).importances(rows)
    assert got.sum() == pytest.approx(1) and got[:2].min() > got[2:].max()
    # A column that never varies is passed over, whatever is drawn.
    flat = df.select(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0), "x0").alias("features"), F.col("y").alias("label"))
    assert ImportanceForest(n_trees=3).importances(flat).tolist() == [0, 0, 0, 0, 1]
    assert ImportanceForest(n_trees=2).importances(flat.filter("label = 0")).sum() == 0
    with pytest.raises(ValueError, match="no training rows"):
        ImportanceForest().importances(flat.limit(0))


@pytest.mark.parametrize("kind", ["own", "tree", "forest"])
def test_tree_contributions_equal_enumeration(spark, kind):
    df, names, x, _ = blobs(spark, n=120, classes=3, d=5)
    xy = to_xy(df, "y", names, keep=["row_key"])
    maker = {"own": DecisionTree(max_depth=4), "tree": DecisionTreeClassifier(maxDepth=4, seed=1),
             "forest": RandomForestClassifier(numTrees=3, maxDepth=4, seed=1)}[kind]
    model = maker.fit(xy)
    few, other = df.filter("row_key < '14'"), df.filter("row_key >= '85'")
    got = {(r["row_key"], r["class"]): r for r in tree_shap(model, few, other, names).table.collect()}
    chosen = [int(r["row_key"]) for r in few.collect()]
    background = [int(r["row_key"]) for r in other.collect()]
    subsets = [s for n in range(6) for s in combinations(range(5), n)]
    # The value of a coalition: mean probability with its columns from the row and the others from the background.
    mixes, owner = [], []
    for i in chosen:
        for s in subsets:
            for b in background:
                row = x[b].copy()
                row[list(s)] = x[i][list(s)]
                mixes.append((f"{i}|{s}", *map(float, row), 0))
    frame = spark.createDataFrame(mixes, "row_key string, " + ", ".join(f"{c} double" for c in names) + ", y int")
    worth = {}
    for r in score(model, to_xy(frame, "y", names, keep=["row_key"]), keep=("row_key",)).collect():
        worth.setdefault(r["row_key"], []).append(r["prob"])
    worth = {k: np.mean(v, axis=0) for k, v in worth.items()}
    for i in chosen:
        for j in range(5):
            want = sum(
                factorial(len(s)) * factorial(4 - len(s)) / factorial(5)
                * (worth[f"{i}|{tuple(sorted((*s, j)))}"] - worth[f"{i}|{s}"]) for s in subsets if j not in s
            )
            assert [got[str(i), c]["shap"][j] for c in range(3)] == pytest.approx(want.tolist(), abs=1e-9)
        assert [got[str(i), c]["base"] for c in range(3)] == pytest.approx(worth[f"{i}|()"].tolist(), abs=1e-9)


def test_decisions_and_waterfalls_need_no_join(spark):
    df, names, _, _ = blobs(spark, n=40)
    rows = df.withColumn("y_true", F.col("y")).withColumn("y_pred", F.lit(1))
    kept = X.linear_shap(rows, rows, names, [0.4, -0.3, 0.2, 0.1], 0.0, keep=("y_true", "y_pred"))
    decided = X.shap_decision(kept)
    joined = X.shap_decision(X.linear_shap(rows, rows, names, [0.4, -0.3, 0.2, 0.1], 0.0), rows)
    assert sorted(map(str, decided.select(*joined.columns).collect())) == sorted(map(str, joined.collect()))
    bars = X.shap_waterfall(kept.predicted_only())
    assert bars.select("row_key").distinct().count() == 40
    for table in (decided, bars):
        assert "Join" not in table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("byte", [True, False])
def test_boosting_counts_one_child_of_a_split(spark, monkeypatch, byte):
    """Rows are counted for the smaller child alone, the other one is the rest; a level is a job of one stage."""
    frame, x, y = levels_frame(spark, n=500, classes=3)
    asked, counted, made = [], B._sums, len(session._MADE)
    monkeypatch.setattr(B, "_sums", lambda rows, splits, level, nodes, *a: asked.append((level, len(nodes))) or counted(rows, splits, level, nodes, *a))
    monkeypatch.setattr(B, "MAX_SENDERS", 24 if byte else 1)
    model = GradientBoosting(n_trees=2, max_depth=3, n_classes=3, key="row_key", row_share=0.7, min_hess=1e-3, rewrite=1).fit(frame.repartition(5))
    for level, nodes in asked:
        assert nodes <= 3 * max(1, 2 ** (level - 1))
    # Blocks are written anew after every round here; only the last ones stay.
    assert sum(Path(at, "blocks").exists() for at in session._MADE[made:]) == 1
    bins = B.bins_of(x, model.edges)
    for trees in model.trees:
        for tree in trees:
            for node in np.flatnonzero(tree.feature >= 0):
                left, right = 2 * node + 1, 2 * node + 2
                assert tree.rows[left] + tree.rows[right] == tree.rows[node] and min(tree.rows[left], tree.rows[right]) > 0
                assert tree.grad[left] + tree.grad[right] == pytest.approx(tree.grad[node])
    dealt = B._dealt(np.ascontiguousarray(bins.T), model.trees[0][0].feature, model.trees[0][0].bin, 2, dict.fromkeys(range(3, 7)))
    reached = model.trees[0][0].route(bins, 2)
    assert {node: rows.tolist() for node, rows in dealt} == {n: np.flatnonzero(reached == n).tolist() for n in range(3, 7) if (reached == n).any()}
