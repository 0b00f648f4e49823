from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.llm.bpe import Tokenizer, read_ranks
from latewise.llm.registry import query, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def tokenizer(vocabulary: str = VOCABULARY) -> Tokenizer:
    return Tokenizer(read_ranks(public_tokenizers.path(vocabulary)), public_tokenizers.PATTERN)


def round_trip(docs: DataFrame) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded bytes of every document."""
    return tokenizer().round_trip(docs).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
