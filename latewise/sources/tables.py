"""Reading and writing tables, fitted objects, reports and result records."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable
from datetime import datetime

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.util import DefaultParamsReader, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    required: Iterable[str] = (),
    fmt: str | None = None,
) -> DataFrame:
    """Parquet or headed CSV. CSV types are inferred (one more pass) only when no schema is given.

    With a schema, CSV columns are taken by their name in the header: a column that the header lacks is an error, one
    that the schema lacks is left out. Every file must have the same header.
    """
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    reader = spark.read
    if fmt != "csv":
        reader = reader if schema is None else reader.schema(schema)
        return require_columns(reader.format(fmt).load(path), required)
    reader = reader.option("header", True).option("encoding", "UTF-8")
    if schema is None:
        return require_columns(reader.option("inferSchema", True).csv(path), required)
    given = reader.csv(path)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    require_columns(given, [*(f.name for f in wanted.fields), *required])
    fields = {f.name: f for f in wanted.fields}
    # In the header's order, and checked against the header of every file.
    ordered = T.StructType([fields.get(c, T.StructField(c, T.StringType())) for c in given.columns])
    return spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", False).schema(
        ordered).csv(path).select(*fields)


def write_splits(df: DataFrame, path: str, split: str = "split", fmt: str = "csv") -> None:
    """One folder per split, so that reading one split touches only its files."""
    writer = df.write.mode("overwrite").partitionBy(split)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_split(
    spark: SparkSession, path: str, name: str | None = None, split: str = "split",
    schema: T.StructType | str | None = None, fmt: str = "csv",
) -> DataFrame:
    df = read_table(spark, path, schema, fmt=fmt)
    return df if name is None else df.filter(F.col(split) == name)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in table order; booleans, dates, text and nested columns are left out."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f) and f.name not in skip]


def to_xy(df: DataFrame, label: str, features: list[str] | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Rows of (kept columns, features vector, label as double) for ``pyspark.ml``.

    The feature names stay in the metadata of the ``features`` column.
    """
    keep = list(keep)
    features = features or numeric_columns(df, [label, *keep])
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    return assembler.transform(df).select(*keep, "features", F.col(label).cast("double").alias("label"))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out over all cores before work that is bound by computing, not by reading.

    Only a source of fewer partitions than cores is dealt out; a larger one stays as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def save_model(model, path: str) -> None:
    """Write a fitted model: the built-in ones their own way, the library's as settings (JSON) and tables (Parquet).

    A model of the library has ``settings()`` and ``tables(spark)``; its class has ``restore(settings, read)``.
    """
    if isinstance(model, MLWritable):
        model.write().overwrite().save(path)
        return
    spark = SparkSession.active()
    kind = type(model)
    head = [(kind.__module__, kind.__qualname__, json.dumps(model.settings()))]
    spark.createDataFrame(head, "module string, name string, settings string").coalesce(1).write.mode("overwrite").json(f"{path}/own")
    for name, table in model.tables(spark).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str):
    """Any model or pipeline that ``save_model`` wrote, also in another session."""
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/own")
    if not own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own):
        return DefaultParamsReader.loadParamsInstance(path, spark)
    head = spark.read.schema("module string, name string, settings string").json(f"{path}/own").first()
    kind = getattr(importlib.import_module(head["module"]), head["name"])
    return kind.restore(json.loads(head["settings"]), lambda name: spark.read.parquet(f"{path}/{name}"))


def stamped(path: str, when: datetime | None = None) -> str:
    """The path with the time behind it, so that a later run does not overwrite an earlier one."""
    return f"{path.rstrip('/')}_{(when or datetime.now()):%Y%m%d_%H%M%S}"


def save_params(params: DataFrame, path: str) -> None:
    """Fitted parameters as a small Parquet table."""
    params.coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Result records (one row per model) as JSON lines."""
    results.coalesce(1).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """A classification report as headed CSV, or as aligned text with four digits."""
    if fmt == "csv":
        report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return
    cells = [F.format_string("%16s", F.col("row"))]
    for field in report.schema.fields[1:]:
        value = F.col(field.name)
        pattern = "%12.4f" if isinstance(field.dataType, T.DoubleType) else "%12d"
        cells.append(F.coalesce(F.when(value.isNotNull(), F.format_string(pattern, value)), F.lit(" " * 12)))
    report.select(F.concat(*cells).alias("value")).coalesce(1).write.mode("overwrite").text(path)
