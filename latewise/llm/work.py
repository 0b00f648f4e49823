"""Tables written once to the shared work folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latewise.session import work_dir


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: what reads the result again reads files, on any executor."""
    path = work_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_thread(spark: SparkSession) -> None:
    """Python workers started from now on use one thread for linear algebra: tasks already fill the cores, and more threads
    would only wait for each other."""
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
