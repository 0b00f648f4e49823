"""A decision tree with exact splits, grown level by level over all nodes at once.

Values are cut into buckets by approximate quantiles found once, and rows are written as blocks (values, buckets, labels).
A level first counts classes per (node, column, bucket): tasks add up numpy histograms, and the partials of a (node, column)
meet in one task. That gives the exact purity of every cut between two buckets. Purity is convex in the counts of the left
side, so its greatest value over the corners of a bucket's box of counts bounds every cut inside that bucket. Only buckets
whose bound reaches the best cut between buckets are then counted value by value, so few values move, and none is missed:
edges decide how much work there is, not the result. Running counts inside a bucket start from the counts before it, so no
window sees more than a bucket, also where a node holds nearly all rows.

Of equally good cuts the first column, then the smallest threshold counts; the threshold is the middle of the two values,
and a row goes left if its value is not above it. A node is split as long as it has two classes and two values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latewise.operators.models.binning import bins_of, vector_of
from latewise.session import work_dir
from latewise.sources.tables import spread


@dataclass(frozen=True)
class Node:
    """A node in heap order (children 2i + 1 and 2i + 2); ``feature`` -1: a leaf. ``counts``: training rows per class."""

    node: int
    feature: int
    threshold: float
    counts: tuple[int, ...]


def _leaf(x: Column, nodes: dict[int, Node], at: int = 0) -> Column:
    """The leaf of a row as nested conditions on the feature array."""
    here = nodes.get(at)
    if here is None or here.feature < 0:
        return F.lit(at)
    left = x[here.feature] <= F.lit(here.threshold)
    return F.when(left, _leaf(x, nodes, 2 * at + 1)).otherwise(_leaf(x, nodes, 2 * at + 2))


_BLOCK = "x binary, bins binary, y binary"
_PART = "node int, col int, hist binary, low binary, high binary"
_PART_SCHEMA = pa.schema([("node", pa.int32()), ("col", pa.int32())] + [(c, pa.binary()) for c in ("hist", "low", "high")])
_OPEN = "node int, col int, best double, bucket binary, bound binary, start binary, total binary, wide binary"
_OPEN_SCHEMA = pa.schema(
    [("node", pa.int32()), ("col", pa.int32()), ("best", pa.float64())]
    + [(c, pa.binary()) for c in ("bucket", "bound", "start", "total", "wide")]
)
_VALUE = "node int, col int, bucket int, v double, y int"
# Corners of a box of counts are tried up to this many classes; with more, every bucket is counted value by value.
MAX_CORNER_CLASSES = 8


def _opened(row: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, bins, y) of a block; the first two have a row for each column."""
    y = np.frombuffer(row["y"], dtype=np.int32)
    return np.frombuffer(row["x"]).reshape(d, len(y)), np.frombuffer(row["bins"], dtype=np.uint16).reshape(d, len(y)), y


def _routed(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, steps: int) -> np.ndarray:
    """Heap number of the node that every row reaches."""
    node, at = np.zeros(x.shape[1], dtype=np.int64), np.arange(x.shape[1])
    for _ in range(steps):
        split = feature[node]
        right = x[np.maximum(split, 0), at] > threshold[node]
        node = np.where(split >= 0, 2 * node + 1 + right, node)
    return node


def purities(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``_purity`` of both sides for counts in the last axis; an empty side counts 0."""
    both = []
    for side in (left, total - left):
        n = side.sum(axis=-1)
        squares = side.astype(np.float64) ** 2
        both.append(sum((squares[..., c] for c in range(1, side.shape[-1])), squares[..., 0]) / np.maximum(n, 1).astype(np.float64))
    return both[0] + both[1]


def open_buckets(hist: np.ndarray, wide: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(best purity of a cut between buckets, buckets, bounds, counts before them) of a histogram buckets x classes.

    The buckets are those that can hold, or end at, a cut no worse than the best; ``wide`` tells which have several values.
    """
    full = np.flatnonzero(hist.sum(axis=1))
    inside, total = hist[full], hist.sum(axis=0)
    end = np.cumsum(inside, axis=0)
    start = end - inside
    at_end = purities(end, total)
    at_end[-1] = -np.inf
    best = float(at_end.max())
    bound = at_end.copy()
    wide = wide[full]
    if hist.shape[1] > MAX_CORNER_CLASSES:
        bound[wide] = np.inf
    elif wide.any():
        corners = [purities(start[wide] + inside[wide] * np.array(c), total) for c in product((0, 1), repeat=hist.shape[1])]
        bound[wide] = np.maximum(bound[wide], np.max(corners, axis=0))
    # The slack covers rounding; what is let in too much is measured exactly.
    kept = np.flatnonzero((bound >= best - 1e-9 * abs(best)) & (bound > -np.inf))
    return best, full[kept], bound[kept], start[kept]


@dataclass(frozen=True)
class DecisionTree:
    """Settings. ``fit`` takes features (vector or array of doubles) and an integer label; no nulls."""

    max_depth: int = 5
    buckets: int = 1_024
    features: str = "features"
    label: str = "label"

    def fit(self, df: DataFrame) -> DecisionTreeModel:
        given = spread(df.select(vector_of(df, self.features).alias("x"), F.col(self.label).cast("int").alias("y")))
        totals = given.groupBy("y").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).orderBy("y").collect()
        if not totals:
            raise ValueError("no training rows")
        classes = [r["y"] for r in totals]
        d = totals[0]["d"]
        edges = self._edges(given, d)
        rows = self._blocks(given, edges, classes)
        wide = [np.ones(len(e) + 1, dtype=bool) for e in edges]
        nodes = {0: Node(0, -1, 0.0, tuple(r["n"] for r in totals))}
        for level in range(self.max_depth):
            first = 2**level - 1
            open_nodes = [i for i in range(first, 2 * first + 1) if i in nodes and sum(c > 0 for c in nodes[i].counts) > 1]
            if not open_nodes:
                break
            cuts = self._cuts(rows, nodes, open_nodes, level, len(classes), wide)
            for r in cuts.collect() if cuts is not None else []:
                best, here = r["best"], nodes[r["node"]]
                left = tuple(best["left"])
                nodes[here.node] = Node(here.node, -best["col"], best["threshold"], here.counts)
                nodes[2 * here.node + 1] = Node(2 * here.node + 1, -1, 0.0, left)
                nodes[2 * here.node + 2] = Node(2 * here.node + 2, -1, 0.0, tuple(a - b for a, b in zip(here.counts, left)))
        return DecisionTreeModel(self, [nodes[i] for i in sorted(nodes)], classes)

    def _edges(self, given: DataFrame, d: int) -> list[np.ndarray]:
        """Upper ends of all but the last bucket of each column; they need not be exact."""
        shares = [i / self.buckets for i in range(1, self.buckets)]
        if not shares:
            return [np.zeros(0)] * d
        found = given.agg(*[F.percentile_approx(F.col("x")[j], shares, 4 * self.buckets).alias(f"q{j}") for j in range(d)]).first()
        return [np.unique(np.array(found[f"q{j}"], dtype=np.float64)) for j in range(d)]

    @staticmethod
    def _blocks(given: DataFrame, edges: list[np.ndarray], classes: list[int]) -> DataFrame:
        """Values, buckets and places of the labels among the classes, written once, a block a batch."""
        known = np.array(classes)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = batch.column("x").flatten().to_numpy().reshape(len(batch), -1)
                    # Adding 0 turns -0.0 into 0.0, which is the same value.
                    cells = [np.ascontiguousarray(x.T) + 0.0, np.ascontiguousarray(bins_of(x, edges).T),
                             np.searchsorted(known, batch.column("y").to_numpy()).astype(np.int32)]
                    if np.isnan(cells[0]).any():
                        raise ValueError("a feature is not a number")
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["x", "bins", "y"])

        path = f"{work_dir(given.sparkSession)}/rows"
        given.mapInArrow(cut, _BLOCK).write.option("compression", "zstd").parquet(path)
        return given.sparkSession.read.schema(_BLOCK).parquet(path)

    def _histograms(self, rows: DataFrame, tree: tuple, open_nodes: list[int], k: int, wide: list[np.ndarray]) -> list:
        """One row for each open node and column: best cut between buckets, and the buckets that may hold a better one.

        The first level also finds which buckets have several values. What is sent has a size that buckets bound, not rows.
        """
        d, first_level = len(wide), open_nodes == [0]
        slot = np.full(2 * max(open_nodes) + 2, -1, dtype=np.int64)
        slot[open_nodes] = np.arange(len(open_nodes))
        sizes = [len(w) for w in wide]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros(len(open_nodes) * size * k, dtype=np.int64) for size in sizes]
            low, high = [np.full(s, np.inf) for s in sizes], [np.full(s, -np.inf) for s in sizes]
            for batch in batches:
                for i in range(len(batch)):
                    x, bins, y = _opened(batch.slice(i, 1).to_pylist()[0], d)
                    place = slot[_routed(x, *tree)]
                    mine = np.flatnonzero(place >= 0)
                    place, label = place[mine], y[mine]
                    for j, size in enumerate(sizes):
                        cell = (place * size + bins[j, mine]) * k + label
                        sums[j] += np.bincount(cell, minlength=len(sums[j]))
                        if first_level:
                            np.minimum.at(low[j], bins[j], x[j])
                            np.maximum.at(high[j], bins[j], x[j])
            for j, size in enumerate(sizes):
                for node, hist in zip(open_nodes, sums[j].reshape(len(open_nodes), -1)):
                    if hist.any():
                        ends = [a[j].tobytes() if first_level else b"" for a in (low, high)]
                        yield pa.RecordBatch.from_pylist(
                            [{"node": node, "col": j, "hist": hist.tobytes(), "low": ends[0], "high": ends[1]}], _PART_SCHEMA)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], list[np.ndarray]] = {}
            for batch in batches:
                for i in range(len(batch)):
                    r = batch.slice(i, 1).to_pylist()[0]
                    sent = [np.frombuffer(r["hist"], dtype=np.int64), np.frombuffer(r["low"]), np.frombuffer(r["high"])]
                    at = (r["node"], r["col"])
                    held[at] = [f(a, b) for f, a, b in zip((np.add, np.minimum, np.maximum), held[at], sent)] if at in held else sent
            out = []
            for (node, col), (hist, low, high) in held.items():
                hist = hist.reshape(-1, k)
                several = low < high if first_level else wide[col]
                best, bucket, bound, start = open_buckets(hist, several)
                out.append({
                    "node": node, "col": col, "best": best, "total": hist.sum(axis=0).tobytes(),
                    "bound": bound.tobytes(), "start": start.tobytes(), "wide": several.tobytes() if first_level else b"",
                    "bucket": np.stack([bucket, _next_full(hist, bucket)]).astype(np.int64).tobytes(),
                })
            yield pa.RecordBatch.from_pylist(out, _OPEN_SCHEMA)

        n_tasks = min(1 + len(open_nodes) * d // 16, rows.sparkSession.sparkContext.defaultParallelism)
        return rows.mapInArrow(partial, _PART).repartition(n_tasks, "node", "col").mapInArrow(merge, _OPEN).collect()

    def _cuts(
        self, rows: DataFrame, nodes: dict[int, Node], open_nodes: list[int], level: int, k: int, wide: list[np.ndarray]
    ) -> DataFrame | None:
        """(node, best): purity, column (negative), value (negative), threshold and left counts of each node's best cut."""
        spark, counts = rows.sparkSession, [f"c{i}" for i in range(k)]
        feature, threshold = np.full(2 ** (level + 1), -1, dtype=np.int64), np.zeros(2 ** (level + 1))
        for n in nodes.values():
            if n.node < len(feature):
                feature[n.node], threshold[n.node] = n.feature, n.threshold
        tree = (feature, threshold, level)
        found = self._histograms(rows, tree, open_nodes, k, wide)
        if open_nodes == [0]:
            for r in found:
                wide[r["col"]] = np.frombuffer(r["wide"], dtype=bool)
        best = {node: max(r["best"] for r in found if r["node"] == node) for node in {r["node"] for r in found}}
        starts, wanted, after = [], set(), set()
        for r in found:
            total = np.frombuffer(r["total"], dtype=np.int64)
            bucket, follower = np.frombuffer(r["bucket"], dtype=np.int64).reshape(2, -1)
            bound, start = np.frombuffer(r["bound"]), np.frombuffer(r["start"], dtype=np.int64).reshape(-1, k)
            least = best[r["node"]] - 1e-9 * abs(best[r["node"]])
            for i in np.flatnonzero(bound >= least):
                starts.append((r["node"], r["col"], int(bucket[i]), *map(int, start[i]), *map(int, total)))
                wanted.add((r["node"], r["col"], int(bucket[i])))
                after.add((r["node"], r["col"], int(follower[i])))
        if not starts:
            return None
        values = self._values(rows, tree, wanted, after - wanted, [len(w) for w in wide])
        cells = values.groupBy("node", "col", "bucket", "v").agg(
            *[F.count_if(F.col("y") == c).alias(name) for c, name in enumerate(counts)]
        )
        path = f"{work_dir(spark)}/cells"
        cells.write.parquet(path)
        cells = spark.read.schema(cells.schema).parquet(path)

        longs = ", ".join(f"{p}{c} long" for p in "bt" for c in counts)
        begun = spark.createDataFrame(starts, f"node int, col int, bucket int, {longs}")
        in_order = Window.partitionBy("node", "col").orderBy("bucket")
        buckets = cells.groupBy("node", "col", "bucket").agg(F.min("v").alias("first"))
        buckets = buckets.select("node", "col", "bucket", F.lead("first").over(in_order).alias("later"))
        buckets = buckets.join(begun, ["node", "col", "bucket"])
        inside = Window.partitionBy("node", "col", "bucket").orderBy("v")
        running = inside.rowsBetween(Window.unboundedPreceding, 0)
        runs = cells.join(buckets, ["node", "col", "bucket"]).select(
            "node", "col", "v", F.coalesce(F.lead("v").over(inside), F.col("later")).alias("next"),
            *[(F.col(f"b{c}") + F.sum(c).over(running)).alias(f"l{c}") for c in counts], *[f"t{c}" for c in counts],
        ).filter(F.col("next").isNotNull())
        left, right = [F.col(f"l{c}") for c in counts], [F.col(f"t{c}") - F.col(f"l{c}") for c in counts]
        middle = (F.col("v") + F.col("next")) / 2
        threshold = F.when(middle >= F.col("next"), F.col("v")).otherwise(middle)
        best = F.max(F.struct(
            (_purity(left) + _purity(right)).alias("purity"), (-F.col("col")).alias("col"), (-F.col("v")).alias("v"),
            threshold.alias("threshold"), F.array(*left).alias("left"),
        ))
        return runs.groupBy("node").agg(best.alias("best"))

    @staticmethod
    def _values(rows: DataFrame, tree: tuple, wanted: set, after: set, sizes: list[int]) -> DataFrame:
        """(node, col, bucket, v, y): all values in the wanted (node, column, bucket), and the least of each block, with
        y -1, in those that only follow one."""
        d, last = len(sizes), max(node for node, _, _ in wanted)
        kind = [np.zeros((last + 1, size), dtype=np.int8) for size in sizes]
        for cells, mark in ((wanted, 1), (after, 2)):
            for node, col, bucket in cells:
                if bucket >= 0:
                    kind[col][node, bucket] = mark

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    x, bins, y = _opened(batch.slice(i, 1).to_pylist()[0], d)
                    node = _routed(x, *tree)
                    reached = np.flatnonzero(node <= last)
                    for j in range(d):
                        if not kind[j].any():
                            continue
                        mark = kind[j][node[reached], bins[j, reached]]
                        mine, least = reached[mark == 1], reached[mark == 2]
                        if len(least):
                            least = least[np.lexsort((x[j, least], bins[j, least], node[least]))]
                            cell = node[least] * sizes[j] + bins[j, least]
                            least = least[np.append(True, cell[1:] != cell[:-1])]
                        both = np.concatenate([mine, least])
                        if len(both):
                            label = np.concatenate([y[mine], np.full(len(least), -1, dtype=np.int32)])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(node[both], pa.int32()), pa.array(np.full(len(both), j), pa.int32()),
                                 pa.array(bins[j, both], pa.int32()), pa.array(x[j, both]), pa.array(label)],
                                ["node", "col", "bucket", "v", "y"])

        return rows.mapInArrow(pick, _VALUE)


def _next_full(hist: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The next bucket with rows after each of the given ones, -1 after the last."""
    full = np.flatnonzero(hist.sum(axis=1))
    return np.append(full, -1)[np.searchsorted(full, bucket, side="right")]


def _purity(counts: list[Column]) -> Column:
    """Sum of squares over the number of rows: weighted Gini impurity is least where the sum of both sides is greatest."""
    squares = [c.cast("double") * c.cast("double") for c in counts]
    return sum(squares[1:], squares[0]) / sum(counts[1:], counts[0]).cast("double")


@dataclass(frozen=True)
class DecisionTreeModel:
    params: DecisionTree
    nodes: list = field(repr=False)
    classes: list

    def transform(self, df: DataFrame) -> DataFrame:
        """Add probability (leaf shares in class order) and prediction, the lowest class on ties; built-in functions only."""
        nodes = {n.node: n for n in self.nodes}
        shares = {n.node: [c / sum(n.counts) for c in n.counts] for n in self.nodes if n.feature < 0}
        table = F.create_map(*[F.lit(x) if np.isscalar(x) else F.array(*map(F.lit, x)) for pair in shares.items() for x in pair])
        leaf = _leaf(vector_of(df, self.params.features), nodes)
        known = F.array(*[F.lit(float(c)) for c in self.classes])
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        scored = df.withColumn("_leaf", leaf).withColumn("probability", F.element_at(table, F.col("_leaf"))).drop("_leaf")
        return scored.withColumn("prediction", F.element_at(known, best))

    def settings(self) -> dict:
        return {"params": asdict(self.params), "classes": self.classes}

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        rows = [(n.node, n.feature, float(n.threshold), list(n.counts)) for n in self.nodes]
        return {"nodes": spark.createDataFrame(rows, "node int, feature int, threshold double, counts array<long>")}

    @classmethod
    def restore(cls, settings: dict, read: Callable[[str], DataFrame]) -> DecisionTreeModel:
        rows = read("nodes").orderBy("node").collect()
        nodes = [Node(r["node"], r["feature"], r["threshold"], tuple(r["counts"])) for r in rows]
        return cls(DecisionTree(**settings["params"]), nodes, settings["classes"])
