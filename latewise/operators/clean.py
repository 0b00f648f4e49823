"""Dropping, filling, merging and row selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewise.sources.tables import numeric_columns, require_columns

# Columns that carry no signal. The published list loses four names to missing commas.
DROP_COLUMNS = [
    "customer_email", "customer_fname", "customer_lname", "customer_password", "order_state",
    "order_customer_id", "order_item_id", "order_city", "product_image", "address_dest", "order_country",
]
PUBLISHED_DROP_COLUMNS = [
    "customer_email", "customer_fname", "customer_lname", "customer_password", "order_item_id",
    "address_dest", "order_country",
]


def drop_if_exists(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*cols)


def drop_strict(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    cols = list(cols)
    return require_columns(df, cols).drop(*cols)


def drop_columns(df: DataFrame, as_published: bool = False) -> DataFrame:
    return drop_if_exists(df, PUBLISHED_DROP_COLUMNS if as_published else DROP_COLUMNS)


def fill_all(df: DataFrame) -> DataFrame:
    """Null to 0 in numbers and to '0' in text."""
    return df.fillna(0).fillna("0")


def fill_leading(df: DataFrame, n: int = 5) -> DataFrame:
    """Null to 0 (text: '0') in the first n columns by position."""
    leading = df.columns[:n]
    return df.fillna(0, subset=leading).fillna("0", subset=leading)


def fill_numeric(df: DataFrame, label: str | None = None) -> DataFrame:
    """Null to 0 in every numeric column except the label."""
    targets = numeric_columns(df, [label] if label else [])
    return df.fillna(0, subset=targets) if targets else df


def null_totals(df: DataFrame, label: str | None = None, n: int = 5) -> DataFrame:
    """(part, n_null): the nulls that ``fill_leading`` and then ``fill_numeric`` find, from one pass.

    A leading numeric column is filled by the first, so the second finds none there.
    """
    leading = df.columns[:n]
    numeric = [c for c in numeric_columns(df, [label] if label else []) if c not in leading]

    def nulls(cols: list[str]) -> Column:
        return sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0)).cast("long")

    counts = df.agg(nulls(leading).alias("leading"), nulls(numeric).alias("numeric"))
    parts = [F.struct(F.lit(c).alias("part"), F.col(c).alias("n_null")) for c in ("leading", "numeric")]
    return counts.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def merge_dedup(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append by column name (absent columns become null) and keep one of each set of equal rows.

    ``distinct`` combines copies inside each task before the shuffle, so a row with very many copies
    sends at most one record per task.
    """
    return a.unionByName(b, allowMissingColumns=True).distinct()


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest keys: each task keeps n rows, one merges them."""
    return df.orderBy(key).limit(n)


def misclassified(pred: DataFrame) -> DataFrame:
    return pred.filter(F.col("y_true") != F.col("y_pred"))
