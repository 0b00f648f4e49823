"""From two raw tables to scaled training tables for the five-class study."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewise.operators.clean import fill_leading, fill_numeric, merge_dedup, null_totals
from latewise.operators.scale import Standardizer
from latewise.operators.split import StratifiedSplit, unique_key
from latewise.plans.binary import Prepared, materialize
from latewise.sources.tables import require_columns


def prepare_five_class(a: DataFrame, b: DataFrame, label: str, key: str | None = None, seed: int = 42) -> Prepared:
    """Merge, remove exact duplicates, fill nulls, split 8:1:1 within classes, scale with training statistics.

    Without a key column the content of the merged row, before nulls are filled, is its key: filling can make rows
    equal that were not.
    """
    for part in (a, b):
        require_columns(part, [label])
    merged = merge_dedup(a, b)
    if key is None:
        key = "row_key"
        merged = unique_key(merged, key)
    rows = fill_numeric(fill_leading(merged), label)
    given = F.coalesce(F.col(label).cast("long"), F.raise_error(F.lit("a row has no label")).cast("long"))
    rows = materialize(rows.withColumn(label, given), "merged")
    features = [c for c in rows.columns if c not in (label, key)]
    split = StratifiedSplit.fit(rows, label, key, seed=seed)
    rows = split.apply(rows)
    scaler = Standardizer.fit(rows.filter(F.col("split") == "train"), features)
    return Prepared(scaler.apply(rows), features, scaler, split, null_totals(merged, label))
