"""Feature vectors cut into bins by approximate quantiles, for models that work on histograms."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_of(df: DataFrame, name: str) -> Column:
    """A vector or array column as an array of doubles."""
    return vector_to_array(name) if dict(df.dtypes)[name] == "vector" else F.col(name).cast("array<double>")


def quantile_edges(df: DataFrame, features: str, max_bins: int) -> list[np.ndarray]:
    """Upper ends of all but the last bin of every column, from one pass; exact where a column has few values."""
    x = vector_of(df, features)
    d = df.select(F.max(F.size(x))).first()[0]
    if not d or d < 1:
        raise ValueError("no training rows")
    shares = [i / max_bins for i in range(1, max_bins)]
    cut = df.select(x.alias("x")).agg(*[
        F.percentile_approx(F.col("x")[j], shares, 100 * max_bins).alias(f"q{j}") for j in range(d)
    ]).first()
    return [np.unique(np.array(cut[f"q{j}"], dtype=np.float64)) for j in range(d)]


def bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b holds the values above edge b - 1 and not above edge b."""
    return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1).astype(np.uint16)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor, shift, multiply)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
