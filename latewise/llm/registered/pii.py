from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.llm.pii import KINDS, RULES, as_text, find_personal_data
from latewise.llm.registry import query, table


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule spans and added spans of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("rules", lambda s: s.kind == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"), *(count(k) for k in RULES),
        F.sha2(as_text(F.col("rules")), 256).alias("base_sha256"), as_text(F.concat("rules", "added")).alias("spans"),
    )
