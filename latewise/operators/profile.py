"""Counts, shares, missing values and table shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latewise.sources.tables import is_numeric


def value_counts(df: DataFrame, col: str, normalize: bool = False, by: str | None = None) -> DataFrame:
    """Rows per value, largest first; with ``normalize`` also the share (within ``by`` if given)."""
    keys = [by, col] if by else [col]
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    if normalize:
        # One row per value: the window sees the counts, not the table.
        total = F.sum("n").over(Window.partitionBy(*([by] if by else [])))
        counts = counts.withColumn("share", F.col("n") / total)
    return counts.orderBy(F.desc("n"), *keys)


def class_ratio(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Rows and percentage (two digits) of each class in each split, sorted by class."""
    counts = value_counts(df, label, normalize=True, by=split)
    return counts.select(
        F.col(split).alias("split"), F.col(label).alias("class"), "n",
        F.round(F.col("share") * 100, 2).alias("percent"),
    ).orderBy("split", "class")


def _melt(row: DataFrame, names: list[str], value: str) -> DataFrame:
    """One-row frame with a column per name to (column, value) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias(value)) for n in names])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n_null) for every column, from one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return _melt(counts, df.columns, "n_null")


def missing_report(df: DataFrame) -> DataFrame:
    """Columns that hold nulls, with their number."""
    return null_counts(df).filter(F.col("n_null") > 0)


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric and other columns: one row."""
    numeric = sum(is_numeric(f) for f in df.schema.fields)
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(numeric).alias("n_numeric"),
        F.lit(len(df.columns) - numeric).alias("n_other"),
    )


def prediction_distribution(pred: DataFrame) -> DataFrame:
    """Rows per class among predictions and among true labels, from one grouped pass."""
    pairs = pred.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    roles = F.array(
        F.struct(F.lit("true").alias("kind"), F.col("y_true").alias("class"), "n"),
        F.struct(F.lit("predicted").alias("kind"), F.col("y_pred").alias("class"), "n"),
    )
    return (
        pairs.select(F.explode(roles).alias("r")).select("r.*")
        .groupBy("kind", "class").agg(F.sum("n").alias("n"))
    )
