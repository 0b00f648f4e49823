"""Exact stratified train / validation / test split by hashed row keys."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CLASSES = 1_000
# Rows are first counted by this many leading hex digits of their hash; cells of more rows than the limit are then
# counted by some more digits.
PREFIX, MORE_DIGITS, MAX_CELL, DIGITS = 4, 2, 50_000, 32


def _shares(counts: dict, draws: int) -> dict:
    """Largest-remainder shares of ``draws`` among classes; equal remainders go to the lower class."""
    total = sum(counts.values())
    exact = {c: n / total * draws for c, n in counts.items()}
    shares = {c: math.floor(x) for c, x in exact.items()}
    missing = draws - sum(shares.values())
    by_remainder = sorted(counts, key=lambda c: (-(exact[c] - shares[c]), c))
    for c in by_remainder[:missing]:
        shares[c] += 1
    return shares


def split_quotas(counts: dict, test: float = 0.1, val: float = 0.1) -> dict:
    """Rows of every class that go to test and to validation.

    Both sizes are rounded up in double arithmetic, the second from the rows left and the fraction
    val / (1 - test), as a two-step split computes them. Training gets its proportional share first.
    """
    n = sum(counts.values())
    n_test = math.ceil(test * n)
    rest = _shares(counts, n - n_test)
    n_val = math.ceil(val / (1 - test) * (n - n_test))
    train = _shares(rest, n - n_test - n_val)
    return {c: (counts[c] - rest[c], rest[c] - train[c]) for c in counts}


@dataclass(frozen=True)
class StratifiedSplit:
    """Per class the last hash that goes to test and the last that goes to validation.

    Splitting is then one projection: no row moves and the key alone decides. Keys must be unique and not null:
    a null key, or a key that repeats where a quota ends, is an error. ``unique_key`` makes such keys unique.
    """

    label: str
    key: str
    seed: int
    limits: dict

    @staticmethod
    def fit(
        df: DataFrame, label: str, key: str, test: float = 0.1, val: float = 0.1, seed: int = 42, prefix: int = PREFIX,
        max_cell: int = MAX_CELL,
    ) -> StratifiedSplit:
        """A few passes over label and key only.

        Counts per (class, hash prefix) give the quotas and tell in which prefix each quota is used up. Those prefixes
        alone are lengthened, pass by pass, until no more than ``max_cell`` rows share one; only these are then ranked,
        whatever the size of the table. The first counts (at most 65,536 per class) are held while both answers are
        read from them.
        """
        rows = df.select(F.col(label).alias("label"), _hash(key, seed).alias("hash"))
        rows = rows.withColumn("prefix", F.substring("hash", 1, prefix))
        rows = rows.withColumn("no_key", F.col("hash").isNull())
        cells = rows.groupBy("label", "prefix").agg(
            F.count("*").alias("n"), F.sum(F.col("no_key").cast("long")).alias("no_key")
        ).persist()
        try:
            return StratifiedSplit._from_cells(rows, cells, label, key, test, val, seed, max_cell)
        finally:
            cells.unpersist()

    @staticmethod
    def _from_cells(
        rows: DataFrame, cells: DataFrame, label: str, key: str, test: float, val: float, seed: int, max_cell: int
    ) -> StratifiedSplit:
        found = cells.groupBy("label").agg(F.sum("n").alias("n"), F.sum("no_key").alias("no_key"))
        found = found.limit(MAX_CLASSES + 1).collect()
        if any(r["no_key"] for r in found):
            raise ValueError(f"{sum(r['no_key'] for r in found)} rows have no {key}; see unique_key")
        if len(found) > MAX_CLASSES:
            raise ValueError(f"{label} has more than {MAX_CLASSES} values; it is not a class label")
        quotas = split_quotas({r["label"]: r["n"] for r in found}, test, val)
        ends = [(c, name, end) for c, (t, v) in quotas.items() for name, end in (("test", t), ("val", t + v)) if end > 0]
        if not ends:
            return StratifiedSplit(label, key, seed, {})

        running = Window.partitionBy("label").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("upto", F.sum("n").over(running))
        wanted = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(name).alias("part"), F.lit(end).cast("long").alias("end")) for c, name, end in ends])
        crossing = (
            cells.withColumn("w", F.explode(F.filter(wanted, lambda w: (
                (w["c"] == F.col("label")) & (F.col("upto") - F.col("n") < w["end"]) & (w["end"] <= F.col("upto"))
            ))))
            .select("label", "prefix", "w.part", (F.col("w.end") - F.col("upto") + F.col("n")).alias("need"), "n")
            .collect()
        )
        crossing = StratifiedSplit._refined(rows, [tuple(r) for r in crossing], max_cell)
        by_hash = Window.partitionBy("label", "part").orderBy("hash")
        placed = StratifiedSplit._cells_of(rows, crossing)
        last = (
            placed.withColumns({"rank": F.row_number().over(by_hash), "next": F.lead("hash").over(by_hash)})
            .filter(F.col("rank") == F.col("need")).select("label", "part", "hash", "next").collect()
        )
        if any(r["hash"] == r["next"] for r in last):
            raise ValueError(f"{key} repeats where a part of the split ends; see unique_key")
        limits: dict = {}
        for r in last:
            limits.setdefault(r["label"], {})[r["part"]] = r["hash"]
        return StratifiedSplit(label, key, seed, limits)

    @staticmethod
    def _cells_of(rows: DataFrame, crossing: list[tuple]) -> DataFrame:
        """(label, hash, part, prefix, need): the rows that share a prefix in which a quota ends."""
        wanted = F.array(*[
            F.struct(F.lit(c).alias("c"), F.lit(p).alias("prefix"), F.lit(part).alias("part"), F.lit(need).cast("long").alias("need"))
            for c, p, part, need, _ in crossing
        ])
        mine = F.filter(wanted, lambda w: (w["c"] == F.col("label")) & F.col("hash").startswith(w["prefix"]))
        return rows.select("label", "hash", F.explode(mine).alias("w")).select("label", "hash", "w.part", "w.prefix", "w.need")

    @staticmethod
    def _refined(rows: DataFrame, crossing: list[tuple], max_cell: int) -> list[tuple]:
        """(label, prefix, part, need, n) with prefixes so long that n is at most ``max_cell``, or that are whole hashes."""
        while True:
            large = [w for w in crossing if w[4] > max_cell and len(w[1]) < DIGITS]
            if not large:
                return crossing
            longer = F.substring("hash", F.lit(1), F.length("prefix") + MORE_DIGITS)
            counts = StratifiedSplit._cells_of(rows, large).groupBy("label", "part", longer.alias("longer")).agg(F.count("*").alias("n"))
            # At most 256 cells for each quota.
            found: dict = {}
            for r in sorted(counts.collect(), key=lambda r: r["longer"]):
                found.setdefault((r["label"], r["part"]), []).append((r["longer"], r["n"]))
            crossing = [w for w in crossing if w not in large]
            for c, _, part, need, _ in large:
                for prefix, n in found[c, part]:
                    if need <= n:
                        crossing.append((c, prefix, part, need, n))
                        break
                    need -= n

    def apply(self, df: DataFrame, out: str = "split") -> DataFrame:
        # A column of its own, so that the hash is computed once for both comparisons.
        hashed = df.withColumn("_hash", _hash(self.key, self.seed))
        value = F.col("_hash")
        part = F.when(value <= self._limit("test"), "test").when(value <= self._limit("val"), "val").otherwise("train")
        return hashed.withColumn(out, part).drop("_hash")

    def _limit(self, part: str) -> Column:
        known = {c: parts[part] for c, parts in self.limits.items() if part in parts}
        if not known:
            return F.lit("")
        table = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
        return F.coalesce(F.try_element_at(table, F.col(self.label)), F.lit(""))


def _hash(key: str, seed: int) -> Column:
    """Null for a null key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def unique_key(df: DataFrame, out: str, cols: list[str] | None = None) -> DataFrame:
    """Add a key made of the row's content and, for rows that repeat, their number.

    The content is unambiguous: nulls differ from any text, and separators inside a text are doubled. Rows that repeat
    are interchangeable, so their numbers may fall either way.
    """
    parts = [
        F.coalesce(F.concat(F.lit("="), F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("||"))), F.lit("~"))
        for c in cols or df.columns
    ]
    content = df.withColumn(out, F.md5(F.concat_ws("|", *parts)))
    number = F.row_number().over(Window.partitionBy(out).orderBy(F.lit(0)))
    return content.withColumn("_number", number).withColumn(
        out, F.concat_ws("-", out, F.col("_number").cast("string"))
    ).drop("_number")


def stratified_split(
    df: DataFrame, label: str, key: str, test: float = 0.1, val: float = 0.1, seed: int = 42
) -> DataFrame:
    return StratifiedSplit.fit(df, label, key, test, val, seed).apply(df)
