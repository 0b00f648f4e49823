from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.llm.registry import query, table
from latewise.llm.sharding import rendezvous, shuffle_into_shards

SHARDS, SEED = 24, 7


@query("op1_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shuffled shards, with the shard each would have among 25."""
    out = shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS, seed=SEED)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return out.select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot",
        rendezvous(F.col("record.doc_id"), SHARDS + 1, SEED).alias("grown_shard"),
    )
