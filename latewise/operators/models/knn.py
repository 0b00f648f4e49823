"""Exact k-nearest-neighbour classification over a metric tree of two levels.

Pivots are training rows: about the square root of the number of leaves opens outer balls, the others are the inner
pivots of their nearest outer ball. One pass puts every training row into the leaf of its nearest inner pivot and
keeps the radii; the rows are written once with their leaf. A query first searches its home leaf, so the distance of the
k-th row found there bounds the k-th neighbour. With that bound the triangle inequality rules out outer balls, then the
leaves of the others, before any training row meets the query again. Leaves, and the queries that visit them, are cut
into blocks of bounded size, so a leaf that holds a third of all rows becomes many tasks. A block emits at most k rows a
query, and no pair of rows is formed outside a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latewise.session import work_dir

BLOCK_ROWS = 2_048


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all rows to all pivots, a few rows at a time."""
    step = max(1, 4_000_000 // max(1, pivots.size))
    parts = [np.sqrt(((x[i:i + step, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)) for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(pivots)))


@dataclass(frozen=True)
class MetricTree:
    """Outer pivots, inner pivots sorted by outer ball, and where the leaves of each ball begin.

    ``low`` and ``high`` bound the distances of a leaf's rows to its inner pivot, ``reach`` those of a ball's rows to
    its outer pivot; ``count`` is the number of rows of a leaf. They are set by the pass over the rows.
    """

    outer: np.ndarray
    inner: np.ndarray
    begin: np.ndarray
    count: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    reach: np.ndarray | None = None

    @classmethod
    def over(cls, pivots: np.ndarray) -> MetricTree:
        n_outer = max(1, int(np.ceil(np.sqrt(len(pivots)))))
        outer = pivots[:n_outer]
        # Every outer pivot is an inner pivot of its own ball too, so no ball is without leaves.
        ball = np.concatenate([np.arange(n_outer), _distances(pivots[n_outer:], outer).argmin(axis=1)])
        order = np.argsort(ball, kind="stable")
        return cls(outer, pivots[order], np.searchsorted(ball[order], np.arange(n_outer + 1)))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ball, leaf, and the distances to their pivots, of every row."""
        to_outer = _distances(x, self.outer)
        ball = to_outer.argmin(axis=1)
        leaf, near = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for b in np.unique(ball):
            mine = np.flatnonzero(ball == b)
            d = _distances(x[mine], self.inner[self.begin[b]:self.begin[b + 1]])
            leaf[mine], near[mine] = self.begin[b] + d.argmin(axis=1), d.min(axis=1)
        return ball, leaf, to_outer[np.arange(len(x)), ball], near

    def visits(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves that can hold a training row within the bound of a row."""
        limit = bound * (1 + 1e-9) + 1e-9
        to_outer = _distances(x, self.outer)
        rows, leaves = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for b in range(len(self.outer)):
            mine = np.flatnonzero(to_outer[:, b] - self.reach[b] <= limit)
            part = slice(self.begin[b], self.begin[b + 1])
            if not len(mine) or not self.count[part].any():
                continue
            d = _distances(x[mine], self.inner[part])
            gap = np.maximum(d - self.high[part], self.low[part] - d)
            i, j = np.nonzero((gap <= limit[mine, None]) & (self.count[part] > 0))
            rows.append(mine[i])
            leaves.append(self.begin[b] + j)
        return np.concatenate(rows), np.concatenate(leaves)


def _block_neighbours(query: pd.DataFrame, train: pd.DataFrame, k: int, cells: int = 2_000_000) -> pd.DataFrame:
    """The k nearest training rows of each query inside one block, ties by training key.

    Distances of ``cells`` pairs, and coordinates of as many numbers, are held at a time, however many pairs tie.
    """
    q, t = _matrix(query["x"]), _matrix(train["x"])
    place, width = min(k, len(t)) - 1, (t**2).sum(1)
    by_key = pd.factorize(train["key"], sort=True)[0]
    by_key = np.where(by_key < 0, len(t), by_key)
    step, pairs = max(1, cells // len(t)), max(1, cells // max(1, q.shape[1]))
    held = []
    for at in range(0, len(q), step):
        part = q[at:at + step]
        own = (part**2).sum(1)
        rough = own[:, None] + width[None, :] - 2 * part @ t.T
        limit = np.partition(rough, place, axis=1)[:, place]
        # The fast form is only a sieve; what passes is measured exactly.
        slack = 1e-9 * (1 + np.abs(limit) + own)
        qi, ti = np.nonzero(rough <= (limit + slack)[:, None])
        exact = np.concatenate([
            np.sqrt(((part[qi[i:i + pairs]] - t[ti[i:i + pairs]]) ** 2).sum(axis=1)) for i in range(0, max(1, len(qi)), pairs)
        ])
        order = np.lexsort((by_key[ti], exact, qi))
        qi, ti, exact = qi[order], ti[order], exact[order]
        first = np.flatnonzero(np.append(True, qi[1:] != qi[:-1]))
        rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
        held.append((at + qi[rank < k], ti[rank < k], exact[rank < k]))
    qi, ti, exact = (np.concatenate(c) for c in zip(*held))
    return pd.DataFrame({
        "key": query["key"].to_numpy()[qi], "distance": exact,
        "train_key": train["key"].to_numpy()[ti], "label": train["label"].to_numpy()[ti],
    })


def _visit_batches(tree: MetricTree, batch: pd.DataFrame, cells: int = 4_000_000, rows: int = 16_384) -> Iterator[pd.DataFrame]:
    """(key, x, leaf) of the leaves that queries must still visit, ``rows`` at a time: a query can visit every leaf."""
    step = max(1, cells // len(tree.inner))
    key, x = batch["key"].to_numpy(), batch["x"].to_numpy()
    home, bound = batch["leaf"].to_numpy(), batch["bound"].to_numpy()
    for at in range(0, len(batch), step):
        i, leaf = tree.visits(_matrix(batch["x"].iloc[at:at + step]), bound[at:at + step])
        i = i + at
        keep = leaf != home[i]
        i, leaf = i[keep], leaf[keep]
        for first in range(0, len(i), rows):
            mine = i[first:first + rows]
            yield pd.DataFrame({"key": key[mine], "x": x[mine], "leaf": leaf[first:first + rows]})


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; the limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("distance", "train_key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


@dataclass(frozen=True)
class NearestNeighbours:
    """Euclidean distance, uniform vote. A leaf has about ``leaf_rows`` rows; there are at most ``max_leaves``."""

    key: str
    k: int = 10
    features: str = "features"
    label: str = "label"
    leaf_rows: int = 512
    max_leaves: int = 16_384
    block_rows: int = BLOCK_ROWS

    def _rows(self, df: DataFrame, with_label: bool) -> DataFrame:
        kind = dict(df.dtypes)[self.features]
        x = vector_to_array(self.features) if kind == "vector" else F.col(self.features).cast("array<double>")
        cols = [F.col(self.key).alias("key"), x.alias("x")]
        return df.select(*cols, F.col(self.label).cast("int").alias("label")) if with_label else df.select(*cols)

    def fit(self, train: DataFrame) -> NearestNeighboursModel:
        rows = self._rows(train, True)
        classes = rows.groupBy("label").count().orderBy("label").collect()
        n = sum(r["count"] for r in classes)
        if not n:
            raise ValueError("no training rows")
        # The pivots: a bounded sample of rows, by the md5 of their keys.
        wanted = min(self.max_leaves, max(1, round(n / self.leaf_rows)))
        chosen = rows.orderBy(F.md5(F.col("key").cast("string")), "key").limit(wanted).collect()
        tree = MetricTree.over(np.array([r["x"] for r in chosen], dtype=np.float64))

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    ball, leaf, out, near = tree.place(_matrix(batch["x"]))
                    yield batch.assign(ball=ball, leaf=leaf, out=out, near=near)

        kind = dict(rows.dtypes)["key"]
        schema = f"key {kind}, x array<double>, label int, ball int, leaf int, out double, near double"
        path = f"{work_dir(train.sparkSession)}/neighbours"
        rows.mapInPandas(assign, schema).write.parquet(path)
        placed = train.sparkSession.read.schema(schema).parquet(path)
        leaves = placed.groupBy("leaf", "ball").agg(
            F.count("*").alias("n"), F.min("near").alias("low"), F.max("near").alias("high"), F.max("out").alias("reach")
        ).collect()
        count, low, high = np.zeros(len(tree.inner), dtype=np.int64), np.zeros(len(tree.inner)), np.zeros(len(tree.inner))
        reach = np.zeros(len(tree.outer))
        for r in leaves:
            count[r["leaf"]], low[r["leaf"]], high[r["leaf"]] = r["n"], r["low"], r["high"]
            reach[r["ball"]] = max(reach[r["ball"]], r["reach"])
        tree = MetricTree(tree.outer, tree.inner, tree.begin, count, low, high, reach)
        return NearestNeighboursModel(self, placed.select("key", "x", "label", "leaf"), tree, [r["label"] for r in classes])


@dataclass(frozen=True)
class NearestNeighboursModel:
    params: NearestNeighbours
    train: DataFrame = field(repr=False)
    tree: MetricTree = field(repr=False)
    classes: list

    def home(self, query: DataFrame) -> DataFrame:
        """(key, x, leaf): every query with the leaf of its nearest pivot that has rows."""
        tree = self.tree
        full = np.flatnonzero(tree.count > 0)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = _matrix(batch["x"])
                    leaf = tree.place(x)[1]
                    lost = np.flatnonzero(tree.count[leaf] == 0)
                    leaf[lost] = full[_distances(x[lost], tree.inner[full]).argmin(axis=1)] if len(lost) else leaf[lost]
                    yield batch.assign(leaf=leaf)

        rows = self.params._rows(query, False)
        return rows.mapInPandas(place, f"key {dict(rows.dtypes)['key']}, x array<double>, leaf int")

    def visits(self, bounded: DataFrame) -> DataFrame:
        """(key, x, leaf): the leaves a query must still visit; ``bounded`` has key, x, leaf (home) and bound."""
        tree = self.tree

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from _visit_batches(tree, batch)

        return bounded.mapInPandas(visit, f"key {dict(bounded.dtypes)['key']}, x array<double>, leaf int")

    def _search(self, visits: DataFrame) -> DataFrame:
        """(key, distance, train_key, label): up to k rows of each visited block."""
        p = self.params
        key_type, train_type = dict(visits.dtypes)["key"], dict(self.train.dtypes)["key"]
        rows_of = self.train.sparkSession.createDataFrame(
            [(int(leaf), -(-int(self.tree.count[leaf]) // p.block_rows)) for leaf in np.flatnonzero(self.tree.count > 0)],
            "leaf int, n_tb int",
        )
        # No more rows than leaves, and those are bounded by max_leaves.
        blocks = visits.groupBy("leaf").agg(F.ceil(F.count("*") / p.block_rows).cast("int").alias("n_qb")).join(
            F.broadcast(rows_of), "leaf"
        )
        blocks = F.broadcast(blocks)
        own = F.xxhash64("key")
        left = visits.join(blocks, "leaf").select(
            "key", "x", "leaf", F.pmod(own, "n_qb").cast("int").alias("qb"),
            F.explode(F.sequence(F.lit(0), F.col("n_tb") - 1)).alias("tb"),
        )
        right = self.train.join(blocks, "leaf").select(
            "key", "x", "label", "leaf", F.pmod(own, "n_tb").cast("int").alias("tb"),
            F.explode(F.sequence(F.lit(0), F.col("n_qb") - 1)).alias("qb"),
        )
        k = p.k

        def block(query_rows: pd.DataFrame, train_rows: pd.DataFrame) -> pd.DataFrame:
            if query_rows.empty or train_rows.empty:
                return pd.DataFrame(columns=["key", "distance", "train_key", "label"])
            return _block_neighbours(query_rows, train_rows, k)

        keys = ["leaf", "tb", "qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            block, f"key {key_type}, distance double, train_key {train_type}, label int"
        )

    def bounded(self, query: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Queries with the distance that bounds their k-th neighbour, and what their home leaf holds."""
        spark, k = query.sparkSession, self.params.k
        home = self.home(query)
        path = work_dir(spark)
        home.write.parquet(f"{path}/home")
        home = spark.read.schema(home.schema).parquet(f"{path}/home")
        found = _nearest(self._search(home), k)
        found.write.parquet(f"{path}/found")
        found = spark.read.schema(found.schema).parquet(f"{path}/found")
        far = found.groupBy("key").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
        # A home leaf of fewer than k rows bounds nothing.
        bound = F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf"))
        return home.join(far, "key", "left").select("key", "x", "leaf", bound.alias("bound")), found

    def neighbours(self, query: DataFrame) -> DataFrame:
        """(key, distance, train_key, label): the k nearest training rows of every query."""
        bounded, found = self.bounded(query)
        visits = self.visits(bounded)
        path = f"{work_dir(query.sparkSession)}/visits"
        visits.write.parquet(path)
        found = found.unionByName(self._search(query.sparkSession.read.schema(visits.schema).parquet(path)))
        return _nearest(found, self.params.k)

    def predict(self, query: DataFrame) -> DataFrame:
        """(key, y_pred, prob): vote shares in class order; the lowest class wins a tie."""
        votes = self.neighbours(query).groupBy("key").agg(
            F.count("*").alias("n"), *[F.count_if(F.col("label") == c).alias(f"v{i}") for i, c in enumerate(self.classes)]
        )
        shares = F.array(*[F.col(f"v{i}") / F.col("n") for i in range(len(self.classes))])
        known = F.array(*[F.lit(c) for c in self.classes])
        rows = votes.select(F.col("key").alias(self.params.key), shares.alias("prob"))
        return rows.withColumn("y_pred", F.element_at(known, F.array_position("prob", F.array_max("prob")).cast("int")))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with prediction and probability columns, joined by key."""
        scored = self.predict(df).select(
            self.params.key, F.col("y_pred").cast("double").alias("prediction"), F.col("prob").alias("probability")
        )
        return df.join(scored, self.params.key)

    def settings(self) -> dict:
        return {"params": asdict(self.params), "classes": self.classes, "outer": self.tree.outer.tolist(), "begin": self.tree.begin.tolist(),
                "reach": self.tree.reach.tolist()}

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The training rows with their leaves, and the leaves with their pivots."""
        t = self.tree
        rows = [(i, t.inner[i].tolist(), int(t.count[i]), float(t.low[i]), float(t.high[i])) for i in range(len(t.inner))]
        return {"rows": self.train, "leaves": spark.createDataFrame(rows, "leaf int, pivot array<double>, n long, low double, high double")}

    @classmethod
    def restore(cls, settings: dict, read: Callable[[str], DataFrame]) -> NearestNeighboursModel:
        found = read("leaves").orderBy("leaf").toPandas()
        tree = MetricTree(
            np.array(settings["outer"]), np.stack(found["pivot"].to_numpy()), np.array(settings["begin"]), found["n"].to_numpy(),
            found["low"].to_numpy(), found["high"].to_numpy(), np.array(settings["reach"]),
        )
        return cls(NearestNeighbours(**settings["params"]), read("rows"), tree, settings["classes"])
