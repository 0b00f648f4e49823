from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.llm.line_dedup import dedup_lines
from latewise.llm.registry import query, table


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with how many lines equal an earlier one or lie within two edits of one, and what stays."""
    return dedup_lines(table(spark, sf_dir, "documents"), threshold=2, min_chars=16, equal_chars=1).select(
        "record.doc_id", "n_lines", "n_equal", "n_near", F.length("kept_text").cast("long").alias("kept_chars"),
        F.sha2(F.col("kept_text"), 256).alias("kept_sha256"),
    )
