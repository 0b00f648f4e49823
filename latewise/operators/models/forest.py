"""Impurity importance of a forest of fully grown trees, with small nodes handed off.

All trees grow together. As long as a node has more than ``task_rows`` rows, it is split by one Spark job for all such
nodes: tasks count classes by (tree, node, column, bin), partials of one (tree, node, column) meet in one task. As soon
as a node's rows fit in a task, they go there as packed bins and the subtree is finished, all of its nodes of a level
at once; only its sums of impurity decrease come back. No depth is given: nodes are split until they are pure or no
column varies.

Rows are drawn for a tree by a Poisson count that depends on the row's content and its number among equal rows of a
block, so a forest hardly depends on partitions. Of ``n_candidates`` random columns the one with the largest decrease
wins, the first on ties; more columns are tried where none of those varies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewise.operators.models.binning import bins_of, mixed, quantile_edges, vector_of
from latewise.session import work_dir
from latewise.sources.tables import spread

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
_BLOCK = "bins binary, y binary, h binary"


def _worth(counts: np.ndarray) -> np.ndarray:
    """Sum of squares over size, 0 for nothing; the last axis has the classes."""
    size = counts.sum(axis=-1)
    return (counts**2).sum(axis=-1) / np.maximum(size, 1)


def _cells(key: np.ndarray, classes: np.ndarray, weight: np.ndarray, n_keys: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys that occur, ascending; sums of weights by key and class)."""
    if n_keys * n_classes <= 4 * len(key):
        # Few cells for the rows: they are counted in place, nothing is sorted.
        sums = np.bincount(key * n_classes + classes, weight, minlength=n_keys * n_classes).reshape(n_keys, n_classes)
        found = np.flatnonzero(np.bincount(key, minlength=n_keys))
        return found, sums[found]
    order = np.arange(len(key))
    # Sixteen bits at a time: numpy sorts such numbers by radix.
    for shift in range(0, max(1, int(n_keys - 1).bit_length()), 16):
        digit = (key >> shift).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    sorted_key = key[order]
    opens = np.append(True, sorted_key[1:] != sorted_key[:-1])
    found = sorted_key[opens]
    place = np.cumsum(opens) - 1
    sums = np.bincount(place * n_classes + classes[order], weight[order], minlength=len(found) * n_classes)
    return found, sums.reshape(len(found), n_classes)


def _best_of_column(key: np.ndarray, classes: np.ndarray, weight: np.ndarray, n_bins: int, n_nodes: int, n_classes: int):
    """(gain over the unsplit node, last bin of the left side) of each node's best cut; -1 where there is none.

    ``key`` is node * n_bins + bin.
    """
    found, sums = _cells(key, classes, weight, n_nodes * n_bins, n_classes)
    node, upto = found // n_bins, np.cumsum(sums, axis=0)
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    last = np.append(starts[1:], len(node)) - 1
    before = np.vstack([np.zeros(n_classes), upto[last[:-1]]])
    place = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
    left = upto - before[place]
    whole = left[last]
    gain = _worth(left) + _worth(whole[place] - left) - _worth(whole)[place]
    gain[last] = -1  # everything on one side
    best = np.maximum.reduceat(gain, starts)
    at = np.flatnonzero(gain == best[place])
    first = at[np.searchsorted(place[at], np.arange(len(starts)))]
    gains, cuts = np.full(n_nodes, -1.0), np.zeros(n_nodes, dtype=np.int64)
    gains[node[starts]], cuts[node[starts]] = best, found[first] % n_bins
    return gains, cuts


def finish(bins: np.ndarray, y: np.ndarray, w: np.ndarray, n_classes: int, n_candidates: int, rng: np.random.Generator) -> np.ndarray:
    """Impurity decrease by column of the whole subtree of these rows, a level at a time."""
    d, n_bins = bins.shape[1], int(bins.max()) + 1 if len(bins) else 1
    decrease, node, n = np.zeros(d), np.zeros(len(y), dtype=np.int64), 1
    while len(y):
        counts = np.bincount(node * n_classes + y, w, minlength=n * n_classes).reshape(n, n_classes)
        mixed_node = counts.max(axis=1) < counts.sum(axis=1)
        keep = mixed_node[node]
        bins, y, w, node = bins[keep], y[keep], w[keep], (np.cumsum(mixed_node) - 1)[node[keep]]
        n = int(mixed_node.sum())
        if not n:
            break
        tried = rng.random((n, d)).argsort(axis=1)
        gain, cut, column = np.full(n, -1.0), np.zeros(n, dtype=np.int64), np.full(n, d)
        for turn in range(d):
            asks = np.ones(n, dtype=bool) if turn < n_candidates else gain < 0
            rows = np.flatnonzero(asks[node]) if not asks.all() else np.arange(len(y))
            if not len(rows):
                break
            mine = tried[node[rows], turn]
            key = node[rows] * n_bins + bins[rows, mine]
            new, at = _best_of_column(key, y[rows], w[rows], n_bins, n, n_classes)
            better = (new >= 0) & ((new > gain) | ((new == gain) & (tried[:, turn] < column)))
            gain[better], cut[better], column[better] = new[better], at[better], tried[better, turn]
        split = gain >= 0
        np.add.at(decrease, column[split], gain[split])
        keep = split[node]
        bins, y, w, node = bins[keep], y[keep], w[keep], node[keep]
        right = bins[np.arange(len(y)), column[node]] > cut[node]
        node, n = 2 * (np.cumsum(split) - 1)[node] + right, 2 * int(split.sum())
    return decrease


@dataclass(frozen=True)
class ImportanceForest:
    n_trees: int = 100
    n_candidates: int | None = None
    bootstrap: bool = True
    max_bins: int = 256
    task_rows: int = 500_000
    seed: int = 42
    features: str = "features"
    label: str = "label"
    block_rows: int = 65_536
    job_nodes: int = 1_000

    def importances(self, df: DataFrame) -> np.ndarray:
        """The mean over the trees of each column's share of the impurity decrease."""
        edges = quantile_edges(df, self.features, self.max_bins)
        d, spark = len(edges), df.sparkSession
        classes = [r[0] for r in df.select(F.col(self.label).cast("int")).distinct().orderBy(self.label).collect()]
        blocks = self._blocks(df, edges, classes)
        wanted = self.n_candidates or max(1, int(math.sqrt(d)))
        total = np.zeros((self.n_trees, d))
        tops: list[dict[int, tuple[int, int]]] = [{} for _ in range(self.n_trees)]
        n_rows = df.count()
        crowded = {(t, 0) for t in range(self.n_trees)} if n_rows > self.task_rows else set()
        while crowded:
            best: dict[tuple[int, int], dict[int, tuple]] = {}
            asked = sorted(crowded)
            # A task holds one histogram for each of these nodes and columns.
            for at in range(0, len(asked), self.job_nodes):
                for r in self._level(blocks, tops, asked[at:at + self.job_nodes], d, len(classes)):
                    best.setdefault((r["tree"], r["node"]), {})[r["col"]] = r
            crowded = set()
            for (t, node), found in best.items():
                order = np.random.default_rng([self.seed, t, node]).permutation(d).tolist()
                valid = [c for c in order if found[c]["gain"] >= 0]
                among = [c for c in order[:wanted] if found[c]["gain"] >= 0] or valid[:1]
                if not among:
                    continue
                r = min((found[c] for c in among), key=lambda r: (-r["gain"], r["col"]))
                total[t, r["col"]] += r["gain"]
                tops[t][node] = (r["col"], r["cut"])
                for child, n in ((2 * node + 1, r["nl"]), (2 * node + 2, r["n"] - r["nl"])):
                    if n > self.task_rows:
                        crowded.add((t, child))
        for r in self._rest(blocks, tops, d, len(classes), wanted).collect():
            total[r["tree"]] += np.array(r["decrease"])
        sums = total.sum(axis=1, keepdims=True)
        shares = np.divide(total, sums, out=np.zeros_like(total), where=sums > 0).mean(axis=0)
        return shares / shares.sum() if shares.sum() else shares

    def _blocks(self, df: DataFrame, edges: list[np.ndarray], classes: list[int]) -> DataFrame:
        size, known = self.block_rows, np.array(classes)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), size):
                    part = batch.slice(at, size)
                    bins = bins_of(part.column("x").flatten().to_numpy().reshape(len(part), -1), edges)
                    y = np.searchsorted(known, part.column("y").to_numpy()).astype(np.int32)
                    h = part.column("h").to_numpy().view(np.uint64)
                    order = np.argsort(h, kind="stable")
                    opens = np.append(True, h[order][1:] != h[order][:-1])
                    number = np.arange(len(h)) - np.maximum.accumulate(np.where(opens, np.arange(len(h)), 0))
                    h = h.copy()
                    h[order] += number.astype(np.uint64)
                    cells = [pa.array([c.tobytes()], pa.binary()) for c in (bins, y, h)]
                    yield pa.RecordBatch.from_arrays(cells, ["bins", "y", "h"])

        x = vector_of(df, self.features)
        label = F.col(self.label).cast("int")
        rows = spread(df.select(x.alias("x"), label.alias("y"), F.xxhash64(x, label).alias("h"))).mapInArrow(cut, _BLOCK)
        path = f"{work_dir(df.sparkSession)}/blocks"
        rows.write.parquet(path)
        return df.sparkSession.read.schema(_BLOCK).parquet(path)

    def _drawn(self, h: np.ndarray, tree: int) -> np.ndarray:
        """How often each row is in the tree's sample."""
        if not self.bootstrap:
            return np.ones(len(h), dtype=np.int64)
        salt = np.uint64(np.random.default_rng([self.seed, tree]).integers(0, 2**63))
        return np.searchsorted(_POISSON, mixed(h ^ salt).astype(np.float64) / 2.0**64)

    def _level(self, blocks: DataFrame, tops: list[dict], crowded: list, d: int, n_classes: int) -> list:
        n_bins, wanted = self.max_bins, {}
        for t, node in crowded:
            wanted.setdefault(t, []).append(node)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {(t, i): np.zeros((d, n_bins * n_classes)) for t, nodes in wanted.items() for i in nodes}
            for batch in batches:
                for row in batch.to_pylist():
                    bins, y, h = _opened(row, d)
                    for t, nodes in wanted.items():
                        w, at = self._drawn(h, t), _route(bins, tops[t])
                        for node in nodes:
                            mine = np.flatnonzero((at == node) & (w > 0))
                            for j in range(d):
                                cell = bins[mine, j].astype(np.int64) * n_classes + y[mine]
                                sums[t, node][j] += np.bincount(cell, w[mine], minlength=n_bins * n_classes)
            rows = [
                {"tree": t, "node": node, "col": j, "cells": cells[j].tobytes()} for (t, node), cells in sums.items() for j in range(d)
                if cells[j].any()
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("tree", pa.int32()), ("node", pa.int64()), ("col", pa.int32()), ("cells", pa.binary())]))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    at = (r["tree"], r["node"], r["col"])
                    held[at] = held.get(at, 0) + np.frombuffer(r["cells"])
            rows = []
            for (t, node, col), cells in held.items():
                counts = np.cumsum(cells.reshape(n_bins, n_classes), axis=0)
                whole = counts[-1]
                gain = _worth(counts) + _worth(whole - counts) - _worth(whole)
                gain[(counts.sum(axis=1) == 0) | (counts.sum(axis=1) == whole.sum())] = -1
                cut = int(gain.argmax())
                rows.append({"tree": t, "node": node, "col": col, "gain": float(gain[cut]), "cut": cut,
                             "nl": int(counts[cut].sum()), "n": int(whole.sum())})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("tree", pa.int32()), ("node", pa.int64()), ("col", pa.int32()), ("gain", pa.float64()), ("cut", pa.int32()),
                ("nl", pa.int64()), ("n", pa.int64())]))

        parts = blocks.mapInArrow(partial, "tree int, node long, col int, cells binary")
        n_tasks = min(len(crowded) * d, blocks.sparkSession.sparkContext.defaultParallelism)
        return parts.repartition(n_tasks, "tree", "node", "col").mapInArrow(
            merge, "tree int, node long, col int, gain double, cut int, nl long, n long").collect()

    def _rest(self, blocks: DataFrame, tops: list[dict], d: int, n_classes: int, n_candidates: int) -> DataFrame:
        """(tree, decrease): of each handed-off node."""
        n_trees, seed = self.n_trees, self.seed

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("bins", pa.binary()), ("y", pa.binary()), ("w", pa.binary())])
            for batch in batches:
                for row in batch.to_pylist():
                    bins, y, h = _opened(row, d)
                    for t in range(n_trees):
                        w = self._drawn(h, t)
                        at = np.where(w > 0, _route(bins, tops[t]), -1)
                        yield pa.RecordBatch.from_pylist([
                            {"tree": t, "node": node, "bins": bins[at == node].tobytes(), "y": y[at == node].tobytes(),
                             "w": w[at == node].astype(np.uint8).tobytes()} for node in np.unique(at[at >= 0]).tolist()
                        ], schema)

        def grow(key: tuple, rows: pa.Table) -> pa.Table:
            t, node = key[0].as_py(), key[1].as_py()
            bins, y, w = (b"".join(rows.column(c).to_pylist()) for c in ("bins", "y", "w"))
            rng = np.random.default_rng([seed, t, node])
            bins = np.frombuffer(bins, dtype=np.uint16).reshape(-1, d)
            found = finish(bins, np.frombuffer(y, dtype=np.int32), np.frombuffer(w, dtype=np.uint8).astype(np.float64), n_classes, n_candidates, rng)
            return pa.table({"tree": pa.array([t], pa.int32()), "decrease": pa.array([found.tolist()], pa.list_(pa.float64()))})

        dealt = blocks.mapInArrow(deal, "tree int, node long, bins binary, y binary, w binary")
        # A group is bounded by task_rows; small partitions must not be joined, each group is heavy work.
        dealt = dealt.repartition(max(n_trees, blocks.sparkSession.sparkContext.defaultParallelism), "tree", "node")
        return dealt.groupBy("tree", "node").applyInArrow(grow, "tree int, decrease array<double>")


def _opened(row: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = np.frombuffer(row["y"], dtype=np.int32)
    return np.frombuffer(row["bins"], dtype=np.uint16).reshape(len(y), d), y, np.frombuffer(row["h"], dtype=np.uint64)


def _route(bins: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node of every row below the splits made so far (heap order)."""
    node = np.zeros(len(bins), dtype=np.int64)
    for i in sorted(splits):
        col, cut = splits[i]
        mine = node == i
        node[mine] = 2 * i + 1 + (bins[mine, col] > cut)
    return node
