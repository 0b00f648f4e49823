"""Gradient boosting with second-order statistics over histograms, grown by Spark jobs.

Rows are cut into bins once and kept as blocks (bins, label, hash, margins). A level of all trees of a round is one job of
one stage: tasks add gradients and Hessians by (tree, node, column, bin) of the smaller child of each split, the driver
adds the tasks' sums (many tasks add theirs among themselves first), takes the other child as the rest of its parent and
splits. What is sent depends on nodes and bins, nothing per row reaches the driver, and a task holds one set of sums and
one block whatever its rows. Gradients are added as integers (fixed point), so a model does not depend on partitions or
the order of partial sums, and the rest of a parent is exact.

A leaf's value is -G / (H + reg_lambda). Two classes: logistic loss, one tree a round; more: softmax, a tree for each
class a round, with the diagonal of the Hessian taken twice. The rows that a round draws, with their derivatives, and the
blocks with its new margins are persisted until the next; blocks are written every ``rewrite`` rounds, so a job evaluates
no finished tree and a lost executor costs a few rounds of its blocks.

``max_leaves`` makes growth best-first: only the leaf with the largest gain is split next. A node's best split does not
depend on the order, so the levels are grown as before and the order is replayed over their gains.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.operators.models.binning import bins_of, mixed, quantile_edges, vector_of
from latewise.session import drop_work, shuffles_freed, work_dir
from latewise.sources.tables import spread

SCALE = float(1 << 24)
_BLOCK = "bins binary, y binary, h binary, margin binary"
# Rows of a block as tasks keep it, and how many tasks send their sums to the driver themselves.
BLOCK_ROWS, MAX_SENDERS = 1 << 18, 24


@dataclass(frozen=True)
class Tree:
    """A binary tree in heap order: the children of node i are 2i + 1 and 2i + 2; feature -1 ends.

    ``gain``, ``grad``, ``hess`` and ``rows`` are kept for every node that was looked at.
    """

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    grad: np.ndarray
    hess: np.ndarray
    rows: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        whole = [np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)]
        return cls(*whole, *(np.zeros(size) for _ in range(4)), np.zeros(size, dtype=np.int64))

    def route(self, bins: np.ndarray, steps: int) -> np.ndarray:
        node, at = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(steps):
            split = self.feature[node]
            right = bins[at, np.maximum(split, 0)] > self.bin[node]
            node = np.where(split >= 0, 2 * node + 1 + right, node)
        return node


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the margins (rows x trees of a round), in fixed point."""
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y[:, None], p * (1 - p)
    else:
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        g, h = p - (y[:, None] == np.arange(margin.shape[1])), 2 * p * (1 - p)
    return np.rint(g * SCALE), np.rint(np.maximum(h, 1e-7) * SCALE)


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, reg_lambda: float, min_hess: float, min_rows: int) -> list[np.ndarray]:
    """(bin, gain, gl, hl, nl) of the best cut of every histogram (nodes x bins); rows with bin <= cut go left. Gain 0: none."""
    nodes = np.arange(len(g))
    if g.shape[1] < 2:
        return [np.zeros(len(g), dtype=kind) for kind in (np.int64, np.float64, np.int64, np.int64, np.int64)]
    gl, hl, nl = (np.cumsum(a, axis=1)[:, :-1] for a in (g, h, n))
    total_g, total_h, total_n = (a.sum(axis=1)[:, None] for a in (g, h, n))

    def worth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a / SCALE) ** 2 / (b / SCALE + reg_lambda)

    with np.errstate(divide="ignore", invalid="ignore"):
        # A node at a time: powers of single numbers and of arrays may differ in the last digit.
        whole = np.array([[worth(np.float64(a), np.float64(b))] for a, b in zip(total_g[:, 0], total_h[:, 0])])
        gain = worth(gl, hl) + worth(total_g - gl, total_h - hl) - whole
    fits = (nl >= min_rows) & (total_n - nl >= min_rows) & (hl / SCALE >= min_hess) & ((total_h - hl) / SCALE >= min_hess)
    # Bins without rows repeat the cut before them; the first of equal cuts counts.
    gain = np.where(fits & (nl > 0) & (nl < total_n) & (n[:, :-1] > 0), gain, 0.0)
    cut = gain.argmax(axis=1)
    found = [cut, gain[nodes, cut], gl[nodes, cut], hl[nodes, cut], nl[nodes, cut]]
    none = ~(found[1] > 1e-6)
    for a in found:
        a[none] = 0
    return found


def best_first(tree: Tree, max_leaves: int) -> Tree:
    """The same tree with only those splits that best-first growth makes before it has ``max_leaves`` leaves."""
    kept = np.full(len(tree.feature), -1, dtype=np.int64)
    front = [(-tree.gain[0], 0)] if tree.feature[0] >= 0 else []
    leaves = 1
    while front and leaves < max_leaves:
        _, node = heapq.heappop(front)
        kept[node] = tree.feature[node]
        leaves += 1
        for child in (2 * node + 1, 2 * node + 2):
            if tree.feature[child] >= 0:
                heapq.heappush(front, (-tree.gain[child], child))
    return replace(tree, feature=kept)


@dataclass(frozen=True)
class GradientBoosting:
    """Settings; ``fit`` takes a table of features (vector or array) and labels 0 to ``n_classes`` - 1.

    ``key`` names a column by which rows are drawn; without it the row's content decides, so copies are drawn together.
    """

    n_trees: int = 200
    max_depth: int = 5
    learning_rate: float = 0.01
    row_share: float = 0.8
    column_share: float = 0.8
    reg_lambda: float = 1.0
    min_hess: float = 1.0
    min_rows: int = 1
    max_bins: int = 64
    max_leaves: int | None = None
    n_classes: int = 2
    seed: int = 42
    key: str | None = None
    features: str = "features"
    label: str = "label"
    rewrite: int = 25
    block_rows: int = 32_768

    def _blocks(self, df: DataFrame, edges: list[np.ndarray]) -> DataFrame:
        n_out, size = 1 if self.n_classes == 2 else self.n_classes, self.block_rows
        x = vector_of(df, self.features)
        own = F.xxhash64(self.key) if self.key else F.xxhash64(x, F.col(self.label).cast("int"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), size):
                    part = batch.slice(at, size)
                    values = part.column("x").flatten().to_numpy().reshape(len(part), -1)
                    bins = bins_of(values, edges)
                    cells = [bins, part.column("y").to_numpy().astype(np.int32), part.column("h").to_numpy(), np.zeros((len(part), n_out))]
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["bins", "y", "h", "margin"])

        rows = df.select(x.alias("x"), F.col(self.label).cast("int").alias("y"), own.alias("h"))
        blocks = spread(rows).mapInArrow(cut, _BLOCK)
        # Dealt out evenly over a few tasks a core.
        cores = df.sparkSession.sparkContext.defaultParallelism
        return blocks.repartition(cores * max(1, -(-blocks.rdd.getNumPartitions() // (8 * cores))))

    @staticmethod
    def _held(blocks: DataFrame, d: int, path: str) -> RDD:
        """The blocks, written and read back: a file for each task, put together."""
        spark = blocks.sparkSession
        with shuffles_freed(spark):
            blocks.write.option("compression", "zstd").parquet(path)
        rows = spark.read.schema(_BLOCK).parquet(path).rdd
        return rows.mapPartitions(lambda part: _joined(part, d)).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(self, df: DataFrame) -> BoostedTrees:
        edges = quantile_edges(df, self.features, self.max_bins)
        n_bins, n_out = [len(e) + 1 for e in edges], 1 if self.n_classes == 2 else self.n_classes
        spark, spent, done, paths = df.sparkSession, [], [], [f"{work_dir(df.sparkSession)}/blocks"]
        state = self._held(self._blocks(df, edges), len(edges), paths[0])
        try:
            for turn in range(self.n_trees):
                draw = [np.random.default_rng([self.seed, turn, k]) for k in range(n_out)]
                wanted = max(1, round(self.column_share * len(edges)))
                columns = [np.sort(rng.permutation(len(edges))[:wanted]) for rng in draw]
                done.append(self._grow(state, turn, columns, n_bins))
                # The first level of this round has filled the new state from the one before it.
                while spent:
                    spent.pop().unpersist()
                for path in paths[:-1]:
                    drop_work(spark, path)
                paths = paths[-1:]
                if turn + 1 < self.n_trees:
                    spent.append(state)
                    moved = self._advanced(state, done[-1])
                    if (turn + 1) % self.rewrite:
                        state = moved.persist(StorageLevel.MEMORY_AND_DISK)
                    else:
                        paths.append(f"{work_dir(spark)}/blocks")
                        blocks = spark.createDataFrame(moved.map(_Block.cells), _BLOCK, verifySchema=False)
                        state = self._held(blocks, len(edges), paths[-1])
        finally:
            for rdd in (*spent, state):
                rdd.unpersist()
        return BoostedTrees(self, edges, done)

    def _margins(self, bins: np.ndarray, margin: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
        for one_round in trees:
            for k, tree in enumerate(one_round):
                margin[:, k] += tree.value[tree.route(bins, self.max_depth)]
        return margin

    def _advanced(self, state: RDD, trees: list[Tree]) -> RDD:
        """Blocks with the margins after one more round."""
        small = [replace(tree, gain=_NOTHING, grad=_NOTHING, hess=_NOTHING, rows=_NOTHING) for tree in trees]
        depth = self.max_depth
        return state.map(lambda block: block.advanced(small, depth))

    def _grow(self, state: RDD, turn: int, columns: list[np.ndarray], n_bins: list[int]) -> list[Tree]:
        trees = [Tree.empty(self.max_depth) for _ in columns]
        starts = [np.cumsum([0, *(n_bins[j] for j in cols)]) for cols in columns]
        limit = np.uint64(min(2**64 - 1, int(self.row_share * 2**64)))
        salt = np.uint64(np.random.default_rng([self.seed, turn]).integers(0, 2**63))
        rows = state.map(lambda block: block.drawn(salt, limit)).persist(StorageLevel.MEMORY_AND_DISK)
        cells: dict[tuple[int, int], np.ndarray] = {}
        asked = [(k, 0) for k in range(len(trees))]
        try:
            for level in range(self.max_depth):
                splits = [(tree.feature[:2**level - 1], tree.bin[:2**level - 1]) for tree in trees]
                counted = dict(zip(asked, _sums(rows, splits, level, asked, columns, starts)))
                above, cells = cells, dict(counted)
                for (k, node), found in counted.items():
                    if node:
                        cells[k, node + 1 if node % 2 else node - 1] = above[k, (node - 1) // 2] - found
                asked = self._split(trees, cells, columns, starts)
                if not asked:
                    break
        finally:
            rows.unpersist()
        if self.max_leaves is not None:
            trees = [best_first(tree, self.max_leaves) for tree in trees]
        for tree in trees:
            seen = tree.hess > 0
            tree.value[seen] = -self.learning_rate * tree.grad[seen] / (tree.hess[seen] + self.reg_lambda)
        return trees

    def _split(self, trees: list[Tree], cells: dict, columns: list[np.ndarray], starts: list[np.ndarray]) -> list[tuple[int, int]]:
        """Split the nodes of a level by their histograms; returns the smaller child of each split."""
        smaller = []
        for k, tree in enumerate(trees):
            nodes = [node for t, node in sorted(cells) if t == k and cells[t, node][2, :starts[k][1]].any()]
            if not nodes:
                continue
            whole = np.stack([cells[k, node] for node in nodes])
            best, chosen = None, np.full(len(nodes), columns[k][0])
            for j, a, b in zip(columns[k], starts[k], starts[k][1:]):
                found = best_splits(*(whole[:, i, a:b] for i in range(3)), self.reg_lambda, self.min_hess, self.min_rows)
                # Columns come in ascending order, so the first of equal gains stays.
                better = np.zeros(len(nodes), dtype=bool) if best is None else found[1] > best[1]
                chosen[better] = j
                best = found if best is None else [np.where(better, new, old) for new, old in zip(found, best)]
            totals = whole[:, :, :starts[k][1]].sum(axis=2)
            for i, node in enumerate(nodes):
                g, h, n = map(int, totals[i])
                tree.grad[node], tree.hess[node], tree.rows[node] = g / SCALE, h / SCALE, n
                cut, gain, gl, hl, nl = (a[i].item() for a in best)
                if gain > 0:
                    tree.feature[node], tree.bin[node], tree.gain[node] = chosen[i], cut, gain
                    for child, (cg, ch, cn) in ((2 * node + 1, (gl, hl, nl)), (2 * node + 2, (g - gl, h - hl, n - nl))):
                        tree.grad[child], tree.hess[child], tree.rows[child] = cg / SCALE, ch / SCALE, cn
                    smaller.append((k, 2 * node + 1 if 2 * nl <= n else 2 * node + 2))
        return smaller


_NOTHING = np.zeros(0)


@dataclass(frozen=True)
class _Block:
    """Rows of a task: bins (columns x rows), labels, hashes and margins (rows x trees of a round)."""

    bins: np.ndarray
    y: np.ndarray
    h: np.ndarray
    margin: np.ndarray

    def advanced(self, trees: list[Tree], steps: int) -> _Block:
        margin = self.margin.copy()
        for k, tree in enumerate(trees):
            margin[:, k] += tree.value[tree.route(self.bins.T, steps)]
        return replace(self, margin=margin)

    def cells(self) -> tuple[bytearray, ...]:
        """The block as it is written."""
        bins = np.ascontiguousarray(self.bins.T.astype(np.uint16))
        return tuple(bytearray(a.tobytes()) for a in (bins, self.y, self.h, self.margin))

    def drawn(self, salt: np.uint64, limit: np.uint64) -> _Drawn:
        """The rows of a round; derivatives have 24 bits, so single precision holds them."""
        rows = np.flatnonzero(mixed(self.h ^ salt) <= limit)
        grad, hess = gradients(self.margin.take(rows, axis=0), self.y.take(rows))
        bins = self.bins if len(rows) == len(self.y) else self.bins.take(rows, axis=1)
        return _Drawn(bins, *(np.ascontiguousarray(a.T.astype(np.float32)) for a in (grad, hess)))


@dataclass(frozen=True)
class _Drawn:
    """Bins (columns x rows), gradients and Hessians (trees x rows) of the rows that a round draws."""

    bins: np.ndarray
    grad: np.ndarray
    hess: np.ndarray

    def count(self, sums: np.ndarray, splits: list, level: int, asked: list, columns: list, starts: list) -> None:
        """Add gradients, Hessians and rows of the nodes asked for to ``sums`` (nodes x 3 x bins of the tree's columns)."""
        for k in sorted({k for k, _ in asked}):
            places = {node: i for i, (t, node) in enumerate(asked) if t == k}
            for node, rows in _dealt(self.bins, *splits[k], level, places):
                grad, hess = (a[k] if rows is None else a[k].take(rows) for a in (self.grad, self.hess))
                for j, a, b in zip(columns[k], starts[k], starts[k][1:]):
                    cell = (self.bins[j] if rows is None else self.bins[j].take(rows)).astype(np.int64)
                    for s, weight in enumerate((grad, hess, None)):
                        sums[places[node], s, a:b] += np.bincount(cell, weight, minlength=int(b - a)).astype(np.int64)


def _dealt(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int, wanted: dict) -> list[tuple[int, np.ndarray | None]]:
    """(node, rows) of the wanted nodes of a level that have rows, dealt out from the root down; None: all rows."""
    front: list[tuple[int, np.ndarray | None]] = [(0, None)]
    for step in range(level):
        below = []
        for node, rows in front:
            if feature[node] < 0:
                continue
            values = bins[feature[node]] if rows is None else bins[feature[node]].take(rows)
            right = values > cut[node]
            for child, goes in ((2 * node + 1, ~right), (2 * node + 2, right)):
                if step + 1 < level or child in wanted:
                    mine = np.flatnonzero(goes)
                    if len(mine):
                        below.append((child, mine if rows is None else rows.take(mine)))
        front = below
    return front


def _joined(rows: Iterator, d: int) -> Iterator[_Block]:
    """Written blocks of a task put together, column by column; bins of a byte where they fit."""
    held: list[tuple[np.ndarray, ...]] = []

    def block() -> _Block:
        bins, y, h, margin = (np.concatenate(part) for part in zip(*held))
        bins = np.ascontiguousarray(bins.T)
        return _Block(bins.astype(np.uint8) if bins.max() < 256 else bins, y, h, margin)

    for row in rows:
        held.append(_opened(row, d))
        if sum(len(y) for _, y, _, _ in held) >= BLOCK_ROWS:
            yield block()
            held.clear()
    if held:
        yield block()


def _sums(rows: RDD, splits: list, level: int, asked: list, columns: list, starts: list) -> np.ndarray:
    """The histograms of the nodes asked for over all rows."""
    shape = (len(asked), 3, max(int(s[-1]) for s in starts))

    def partial(blocks: Iterator[_Drawn]) -> Iterator[np.ndarray]:
        sums = np.zeros(shape, dtype=np.int64)
        for block in blocks:
            block.count(sums, splits, level, asked, columns, starts)
        yield sums

    sent = rows.mapPartitions(partial)
    if rows.getNumPartitions() > MAX_SENDERS:
        return sent.treeReduce(np.add, 2)
    return sum(sent.collect())


def _opened(row, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    y = np.frombuffer(row["y"], dtype=np.int32)
    bins = np.frombuffer(row["bins"], dtype=np.uint16).reshape(len(y), d)
    margin = np.frombuffer(row["margin"], dtype=np.float64).reshape(len(y), -1).copy()
    return bins, y, np.frombuffer(row["h"], dtype=np.uint64), margin


@dataclass(frozen=True)
class BoostedTrees:
    params: GradientBoosting
    edges: list = field(repr=False)
    trees: list = field(repr=False)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = bins_of(x, self.edges)
        n_out = 1 if self.params.n_classes == 2 else self.params.n_classes
        return self.params._margins(bins, np.zeros((len(x), n_out)), self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add probability (in class order) and prediction; the lowest class wins a tie."""

        @F.pandas_udf("array<double>")
        def probability(x: pd.Series) -> pd.Series:
            if x.empty:
                return pd.Series([], dtype=object)
            margin = self.margins(np.stack(x.to_numpy()).astype(np.float64))
            if margin.shape[1] == 1:
                p = 1 / (1 + np.exp(-margin[:, 0]))
                return pd.Series(np.stack([1 - p, p], axis=1).tolist())
            e = np.exp(margin - margin.max(axis=1, keepdims=True))
            return pd.Series((e / e.sum(axis=1, keepdims=True)).tolist())

        scored = df.withColumn("probability", probability(vector_of(df, self.params.features)))
        return scored.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def settings(self) -> dict:
        return {"params": asdict(self.params), "edges": [e.tolist() for e in self.edges]}

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """One row for each node that was looked at."""
        rows = [
            (t, k, int(i), int(tree.feature[i]), int(tree.bin[i]), float(tree.value[i]), float(tree.gain[i]), float(tree.grad[i]),
             float(tree.hess[i]), int(tree.rows[i]))
            for t, one_round in enumerate(self.trees) for k, tree in enumerate(one_round) for i in np.flatnonzero(tree.hess > 0)
        ]
        return {"nodes": spark.createDataFrame(
            rows, "turn int, tree int, node int, feature int, bin int, value double, gain double, grad double, hess double, rows long"
        )}

    @classmethod
    def restore(cls, settings: dict, read: Callable[[str], DataFrame]) -> BoostedTrees:
        params = GradientBoosting(**settings["params"])
        n_out = 1 if params.n_classes == 2 else params.n_classes
        found = read("nodes").toPandas()
        trees = [[Tree.empty(params.max_depth) for _ in range(n_out)] for _ in range(int(found["turn"].max()) + 1 if len(found) else 0)]
        for (turn, k), part in found.groupby(["turn", "tree"]):
            tree, at = trees[turn][k], part["node"].to_numpy()
            for name in ("feature", "bin", "value", "gain", "grad", "hess", "rows"):
                getattr(tree, name)[at] = part[name].to_numpy()
        return cls(params, [np.array(e) for e in settings["edges"]], trees)
