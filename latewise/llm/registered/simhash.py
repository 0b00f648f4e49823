from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.llm.registry import query, table
from latewise.llm.simhash import fingerprint_hex, near_duplicates


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of 4-word shingles and its component at 4 bits."""
    near = near_duplicates(table(spark, sf_dir, "documents"), width=4, max_bits=4)
    return near.select(
        F.col("id").alias("doc_id"), fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )
