"""Standardization with population statistics of the training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.operators.select import column_stats


@dataclass(frozen=True)
class Standardizer:
    """(x - mean) / std per column; a column without spread is only centred."""

    params: list[tuple[str, float, float]]

    @staticmethod
    def fit(train: DataFrame, cols: list[str]) -> Standardizer:
        """One pass for all columns."""
        rows = column_stats(train, cols).select("column", "mean", F.sqrt("var").alias("std")).collect()
        fitted = {r["column"]: (r["mean"], r["std"] or 1.0) for r in rows}
        return Standardizer([(c, *fitted[c]) for c in cols])

    def apply(self, df: DataFrame) -> DataFrame:
        """The parameters are literals of one projection; nothing is joined."""
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in self.params})

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.params, "column string, mean double, std double")

    @staticmethod
    def from_df(params: DataFrame) -> Standardizer:
        return Standardizer([(r["column"], r["mean"], r["std"]) for r in params.orderBy("column").collect()])
