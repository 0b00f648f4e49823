from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latewise.llm.quality import COUNTS, fit_ratio, fit_threshold, score_quality
from latewise.llm.registry import query, table


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    ratio = fit_ratio(docs, labels, hold_out=True)
    return score_quality(docs, ratio, fit_threshold(docs, labels, ratio)).select("record.doc_id", *COUNTS, "base_failed", "kept", "score")
