from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.llm.lm import build_lexicon, count_words, fit, held_out, score_documents
from latewise.llm.registry import query, table


@query("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = docs.filter(~held_out(F.col("doc_id")))
    counts = count_words(training)
    lexicon = build_lexicon(counts)
    scored = score_documents(docs, counts, lexicon, fit(training, lexicon))
    return scored.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(lexicon.total).cast("long").alias("train_tokens"), "base_score", "score",
    )
