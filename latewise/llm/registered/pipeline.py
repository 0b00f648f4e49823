from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from latewise.llm.registry import query


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    return corpus_pipeline.run(spark, sf_dir)
