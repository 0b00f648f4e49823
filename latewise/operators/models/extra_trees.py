"""Extremely randomized trees, grown level by level by Spark jobs.

All trees grow together. A level takes two passes over the rows: the first finds the range of a few
random columns in every open node, the second counts classes on both sides of a random threshold for
each of them. In a task the rows of a block are dealt out to the nodes of one tree after the other, column by column, so a
row costs a comparison a level and a few per candidate, and memory is that of a block. A task sends one packed partial per tree, whatever its rows; the partials of a tree are
combined in one task, and the driver keeps only the trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Forest:
    """Complete binary trees in heap order: the children of node i are 2i+1 and 2i+2; feature -1 ends."""

    feature: np.ndarray
    threshold: np.ndarray
    counts: np.ndarray

    def route(self, x: np.ndarray, depth: int) -> np.ndarray:
        """Node of every row in every tree after at most ``depth`` steps."""
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(depth):
            split = self.feature[trees, node]
            right = x[rows, np.maximum(split, 0)] > self.threshold[trees, node]
            node = np.where(split >= 0, 2 * node + 1 + right, node)
        return node


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _vector(df: DataFrame, name: str) -> Column:
    return vector_to_array(name) if dict(df.dtypes)[name] == "vector" else F.col(name).cast("array<double>")


def _blocks(batches: Iterator[pa.RecordBatch], size: int = 65_536) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, labels) of up to ``size`` rows at a time, ordered by label."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> tuple[list[np.ndarray], np.ndarray]:
        x, y = (np.concatenate(part) for part in zip(*held))
        order = np.argsort(y, kind="stable")
        return [np.ascontiguousarray(x[order, j]) for j in range(x.shape[1])], y[order]

    for batch in batches:
        for at in range(0, len(batch), size):
            part = batch.slice(at, size)
            if len(set(pc.list_value_length(part.column("x")).to_pylist())) > 1:
                raise ValueError("rows differ in their number of features")
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            held.append((x, part.column("y").to_numpy(zero_copy_only=False)))
            if sum(len(y) for _, y in held) >= size:
                yield joined()
                held.clear()
    if held:
        yield joined()


def _open_rows(columns: list[np.ndarray], feature: np.ndarray, threshold: np.ndarray, level: int, wanted: np.ndarray):
    """(place in the level, rows) of a tree's wanted nodes that rows of the block lie in. Rows are dealt out from the root
    down; each step looks at the one column its node is split by."""
    front: dict[int, np.ndarray | slice] = {0: slice(None)}
    for _ in range(level):
        below = {}
        for node, rows in front.items():
            if feature[node] >= 0:
                right = columns[feature[node]][rows] > threshold[node]
                for child, goes in ((2 * node + 1, ~right), (2 * node + 2, right)):
                    mine = np.flatnonzero(goes)
                    if len(mine):
                        below[child] = mine if node == 0 else rows[mine]
        front = below
    first = 2**level - 1
    return [(node - first, rows) for node, rows in front.items() if wanted[node - first]]


def _packed(first: np.ndarray, second: np.ndarray, shape: tuple, seen: np.ndarray) -> pa.RecordBatch:
    """One row for each tree that a task saw rows of."""
    trees = np.flatnonzero(seen)
    arrays = [a.reshape(shape[0], -1) for a in (first, second)] if len(second) else [first.reshape(shape[0], -1)]
    cells = [[a[t].tobytes() for t in trees] for a in arrays]
    sent = (cells[0], cells[1] if len(cells) > 1 else [b""] * len(trees))
    return pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), *(pa.array(c, pa.binary()) for c in sent)], ["t", "a", "b"])


def _merged(rows: DataFrame, partial, shape: tuple, *combine) -> list[np.ndarray]:
    """Arrays over all trees: what the tasks sent for a tree is combined in one task, and one row a tree reaches the driver."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for t, *sent in batch[["t", "a", "b"]].itertuples(index=False):
                arrays = [np.frombuffer(s) for s in sent[:len(combine)]]
                held[t] = [f(x, y) for f, x, y in zip(combine, held[t], arrays)] if t in held else arrays
        cells = [[arrays[i].tobytes() for arrays in held.values()] for i in range(len(combine))]
        yield pd.DataFrame({"t": list(held), "a": cells[0], "b": cells[1] if len(cells) > 1 else [b""] * len(held)}).astype({"t": np.int32})

    schema = "t int, a binary, b binary"
    found = rows.mapInArrow(partial, schema).repartition(min(shape[0], rows.sparkSession.sparkContext.defaultParallelism), "t")
    start = {np.minimum: np.inf, np.maximum: -np.inf, np.add: 0.0}
    out = [np.full((shape[0], int(np.prod(shape[1:]))), start[f]) for f in combine]
    for r in found.mapInPandas(merge, schema).collect():
        for array, sent in zip(out, (r["a"], r["b"])):
            array[r["t"]] = np.frombuffer(sent)
    return [array.reshape(shape) for array in out]


@dataclass(frozen=True)
class ExtraTrees:
    """No bootstrap; sqrt(columns) candidates per node, one uniform threshold each, best Gini wins."""

    n_trees: int = 200
    max_depth: int = 5
    seed: int = 42
    features: str = "features"
    label: str = "label"

    def _candidates(self, tree: int, node: int, d: int) -> np.ndarray:
        return np.random.default_rng([self.seed, tree, node]).permutation(d)[: max(1, int(np.sqrt(d)))]

    def fit(self, df: DataFrame) -> ExtraTreesModel:
        rows = df.select(_vector(df, self.features).alias("x"), F.col(self.label).cast("int").alias("y")).persist()
        try:
            return self._grow(rows)
        finally:
            rows.unpersist()

    def _grow(self, rows: DataFrame) -> ExtraTreesModel:
        totals = rows.groupBy("y").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).orderBy("y").collect()
        classes = np.array([r["y"] for r in totals])
        d, n_classes = totals[0]["d"], len(classes)
        size = 2 ** (self.max_depth + 1) - 1
        forest = Forest(
            np.full((self.n_trees, size), -1, dtype=np.int64), np.zeros((self.n_trees, size)),
            np.zeros((self.n_trees, size, n_classes)),
        )
        forest.counts[:, 0, :] = [r["n"] for r in totals]
        for level in range(self.max_depth):
            first, width = 2**level - 1, 2**level
            open_nodes = (forest.counts[:, first:first + width] > 0).sum(axis=2) > 1
            if not open_nodes.any():
                break
            chosen = np.array([
                [self._candidates(t, first + i, d) for i in range(width)] for t in range(self.n_trees)
            ])
            ranges = self._ranges(rows, forest, level, chosen, open_nodes)
            low, high = ranges
            draw = np.random.default_rng([self.seed, level]).uniform(size=low.shape)
            # A threshold equal to the upper end would leave the right side empty.
            cuts = np.minimum(low + draw * (high - low), np.nextafter(high, low))
            usable = open_nodes[:, :, None] & (high > low)
            left = self._left_counts(rows, forest, level, chosen, cuts, usable, classes)
            self._split(forest, level, chosen, cuts, usable, left)
        return ExtraTreesModel(self, forest, [int(c) for c in classes])

    def _ranges(self, rows, forest, level, chosen, open_nodes):
        """(low, high): the range of every candidate in every open node."""
        shape = chosen.shape

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
            for columns, _ in _blocks(batches):
                for t in range(shape[0]):
                    for i, rows in _open_rows(columns, forest.feature[t], forest.threshold[t], level, open_nodes[t]):
                        for j, c in enumerate(chosen[t, i]):
                            values = columns[c][rows]
                            low[t, i, j] = np.minimum(low[t, i, j], values.min())
                            high[t, i, j] = np.maximum(high[t, i, j], values.max())
            yield _packed(low.ravel(), high.ravel(), shape, (low <= high).any(axis=(1, 2)))

        low, high = _merged(rows, partial, shape, np.minimum, np.maximum)
        empty = low > high
        low[empty], high[empty] = 0, 0
        return low, high

    def _left_counts(self, rows, forest, level, chosen, cuts, usable, classes):
        """Rows of every class on the left of every candidate's cut."""
        shape, n_classes = (*chosen.shape, len(classes)), len(classes)
        open_nodes = usable.any(axis=2)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left = np.zeros(shape)
            for columns, y in _blocks(batches):
                for t in range(shape[0]):
                    for i, rows in _open_rows(columns, forest.feature[t], forest.threshold[t], level, open_nodes[t]):
                        # Rows are in the order of their labels, so a class is a slice.
                        mine = y[rows]
                        ends = [*np.searchsorted(mine, classes).tolist(), len(mine)]
                        for j, c in enumerate(chosen[t, i]):
                            goes = columns[c][rows] <= cuts[t, i, j]
                            left[t, i, j] += [np.count_nonzero(goes[a:b]) for a, b in zip(ends, ends[1:])]
            yield _packed(left.ravel(), np.zeros(0), shape, left.any(axis=(1, 2, 3)))

        return _merged(rows, partial, shape, np.add)[0]

    def _split(self, forest, level, chosen, cuts, usable, left) -> None:
        first, width = 2**level - 1, 2**level
        total = forest.counts[:, first:first + width]
        right = total[:, :, None, :] - left
        n_left, n_right = left.sum(axis=3), right.sum(axis=3)
        both = usable & (n_left > 0) & (n_right > 0)
        # Weighted Gini impurity is minimal where the sum of squares over size is maximal.
        purity = (left**2).sum(axis=3) / np.maximum(n_left, 1) + (right**2).sum(axis=3) / np.maximum(n_right, 1)
        best = np.where(both, purity, -np.inf).argmax(axis=2)
        t, i = np.nonzero(both.any(axis=2))
        j, node = best[t, i], first + i
        forest.feature[t, node] = chosen[t, i, j]
        forest.threshold[t, node] = cuts[t, i, j]
        forest.counts[t, 2 * node + 1] = left[t, i, j]
        forest.counts[t, 2 * node + 2] = right[t, i, j]


@dataclass(frozen=True)
class ExtraTreesModel:
    params: ExtraTrees
    forest: Forest = field(repr=False)
    classes: list

    def transform(self, df: DataFrame) -> DataFrame:
        """Add probability (mean of leaf shares over the trees, in class order) and prediction."""
        forest, depth = self.forest, self.params.max_depth
        shares = forest.counts / np.maximum(forest.counts.sum(axis=2, keepdims=True), 1)

        @F.pandas_udf("array<double>")
        def probability(x: pd.Series) -> pd.Series:
            if x.empty:
                return pd.Series([], dtype=object)
            node = forest.route(_matrix(x), depth)
            mean = np.zeros((len(x), shares.shape[2]))
            for t in range(len(shares)):
                mean += shares[t, node[:, t]]
            return pd.Series((mean / len(shares)).tolist())

        known = F.array(*[F.lit(float(c)) for c in self.classes])
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        scored = df.withColumn("probability", probability(_vector(df, self.params.features)))
        return scored.withColumn("prediction", F.element_at(known, best))

    def settings(self) -> dict:
        return {"params": asdict(self.params), "classes": self.classes}

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """One row for each node that training rows reached."""
        f = self.forest
        rows = [
            (int(t), int(i), int(f.feature[t, i]), float(f.threshold[t, i]), f.counts[t, i].tolist())
            for t, i in zip(*np.nonzero(f.counts.sum(axis=2)))
        ]
        return {"nodes": spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, counts array<double>")}

    @classmethod
    def restore(cls, settings: dict, read: Callable[[str], DataFrame]) -> ExtraTreesModel:
        params = ExtraTrees(**settings["params"])
        shape = (params.n_trees, 2 ** (params.max_depth + 1) - 1)
        forest = Forest(np.full(shape, -1, dtype=np.int64), np.zeros(shape), np.zeros((*shape, len(settings["classes"]))))
        found = read("nodes").toPandas()
        at = (found["tree"].to_numpy(), found["node"].to_numpy())
        forest.feature[at], forest.threshold[at] = found["feature"].to_numpy(), found["threshold"].to_numpy()
        forest.counts[at] = np.stack(found["counts"].to_numpy())
        return cls(params, forest, settings["classes"])
