"""Variance filter, F-test and k-best selection; each reads the table once for all columns."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latewise.functions.stats import f_tail
from latewise.sources.tables import numeric_columns

# Fixed values of the study.
VARIANCE_THRESHOLD = 0.01
BEST_K = 50
EFFECTIVE, WEAK = 0.05, 0.01


def column_stats(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """(class, n, place, column, mean, var): population statistics of all columns, per class if given.

    One pass with the built-in vector summarizer, whose loop over the columns stays small however many
    there are; a separate aggregate expression per column would outgrow what the JVM compiles. Nulls
    are an error: fill them first.
    """
    label = F.col(by) if by else F.lit(0)
    values = df.select(label.alias("_class"), *[F.col(c).cast("double").alias(c) for c in cols])
    vectors = VectorAssembler(inputCols=cols, outputCol="_vector", handleInvalid="error").transform(values)
    summary = Summarizer.metrics("count", "mean", "variance").summary(F.col("_vector"))
    stats = vectors.groupBy(F.col("_class").alias("class")).agg(summary.alias("s"))
    stats = stats.select(
        "class", F.col("s.count").cast("double").alias("n"), vector_to_array("s.mean").alias("means"),
        vector_to_array("s.variance").alias("vars"),
    )
    names = F.array(*[F.lit(c) for c in cols])
    zipped = F.arrays_zip(names.alias("column"), F.col("means").alias("mean"), F.col("vars").alias("var"))
    long = stats.select("class", "n", F.posexplode(zipped).alias("place", "z"))
    # The summarizer divides by n - 1 and gives 0 for a single row.
    return long.select(
        "class", "n", "place", F.col("z.column").alias("column"), F.col("z.mean").alias("mean"),
        (F.col("z.var") * (F.col("n") - 1) / F.col("n")).alias("var"),
    )


def variances(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(place, column, variance) with the population variance."""
    stats = column_stats(df, cols or numeric_columns(df))
    return stats.select("place", "column", F.col("var").alias("variance"))


def variance_filter(df: DataFrame, cols: list[str] | None = None, threshold: float = VARIANCE_THRESHOLD) -> list[str]:
    """Names of the columns whose population variance exceeds the threshold."""
    kept = variances(df, cols).filter(F.col("variance") > threshold).orderBy("place").collect()
    return [r["column"] for r in kept]


def _anova(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(place, column, f, variance, df_between, df_within) of the one-way F test of every column against the label.

    One grouped pass gives count, mean and population variance per class; both sums of squares, and
    with them the variance over all rows, follow without subtracting large numbers. Infinite if classes differ and do not vary inside,
    NaN for a constant column.
    """
    long = column_stats(df, cols, label)
    per_column = Window.partitionBy("place")
    centred = long.withColumn("centre", F.sum(F.col("n") * F.col("mean")).over(per_column) / F.sum("n").over(per_column))
    sums = centred.groupBy("place", "column").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("centre"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.sum("n").alias("total"), F.count("*").alias("k"),
    )
    infinite, nan = F.lit(float("inf")), F.lit(float("nan"))
    f = (
        F.when((F.col("k") < 2) | (F.col("total") <= F.col("k")), nan)
        .when((F.col("within") == 0) & (F.col("between") == 0), nan)
        .when(F.col("within") == 0, infinite)
        .otherwise(F.try_divide(
            F.col("between") * (F.col("total") - F.col("k")), F.col("within") * (F.col("k") - 1)
        ))
    )
    variance = (F.col("between") + F.col("within")) / F.col("total")
    return sums.select(
        "place", "column", f.alias("f"), variance.alias("variance"),
        (F.col("k") - 1).cast("double").alias("df_between"), (F.col("total") - F.col("k")).cast("double").alias("df_within"),
    )


def anova_f(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(place, column, f, variance) of the one-way F test of every column against the label."""
    return _anova(df, cols, label).select("place", "column", "f", "variance")


def p_values(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(place, column, f, variance, p): the F test with the tail probability of its statistic, from the same pass."""
    tested = _anova(df, cols, label)
    return tested.select("place", "column", "f", "variance", f_tail(F.col("f"), F.col("df_between"), F.col("df_within")).alias("p"))


def _ten_digits(f: Column) -> Column:
    """The value to ten significant digits."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(f)))
    return F.when((f > 0) & (f < float("inf")), F.round(f / scale, 9) * scale).otherwise(f)


def rank_columns(scores: DataFrame) -> DataFrame:
    """Add the rank by F score: NaN last, and of equal scores the later column first.

    Scores that agree in ten digits count as equal: columns that are multiples of each other differ
    only by rounding, which depends on the order in which partial sums meet.
    """
    order = Window.orderBy(F.isnan("f"), F.desc(_ten_digits(F.col("f"))), F.desc("place"))
    return scores.withColumn("rank", F.row_number().over(order))


def select_k_best(df: DataFrame, cols: list[str], label: str, k: int = BEST_K) -> list[str]:
    """The k best columns by F score, in table order."""
    best = rank_columns(anova_f(df, cols, label)).filter(F.col("rank") <= k).orderBy("place").collect()
    return [r["column"] for r in best]


def validity_counts() -> list[Column]:
    """Aggregates over ``p_values``: columns with p < 0.05 and with p > 0.01. NaN (a constant column) is in neither."""
    testable = ~F.isnan("p")
    return [F.count_if(testable & (F.col("p") < EFFECTIVE)).alias("n_effective"), F.count_if(testable & (F.col("p") > WEAK)).alias("n_weak")]


def feature_validity(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(n_effective, n_weak, n_columns): columns with p < 0.05 and with p > 0.01 in the F test; the two overlap."""
    return p_values(df, cols, label).agg(*validity_counts(), F.count("*").alias("n_columns"))


def select_features(
    df: DataFrame, label: str, threshold: float = VARIANCE_THRESHOLD, k: int = BEST_K,
    keep: tuple[str, ...] = (), exclude: tuple[str, ...] = (),
) -> DataFrame:
    """Variance filter, then k best; returns kept columns, selected features and the label.

    Columns in ``exclude`` (for example ones that give the label away) take no part.
    """
    cols = numeric_columns(df, [label, *keep, *exclude])
    # One pass serves both steps: the F test also yields the variance of every column.
    scores = anova_f(df, cols, label).filter(F.col("variance") > threshold)
    best = rank_columns(scores).filter(F.col("rank") <= k).orderBy("place").collect()
    if not best:
        raise ValueError("no column passes the variance filter")
    return df.select(*keep, *[r["column"] for r in best], label)
