"""Documents to token ids in five stages; each works on what its predecessor kept.

Quality rules reject documents, line dedup takes repeated lines out of texts, SimHash near-dedup keeps the document
with the smallest id of each group, decontamination rejects documents that hold benchmark passages, and the last stage
encodes and decodes what is left. All stages but the last return the columns of ``documents``; ``n_chars`` follows the
text.

Null ids, null or empty texts, repeated rows and empty tables are handled as the operators say; of rows that agree in
id and text near-dedup keeps one. Of a group without any id the smallest text hash decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.llm.decontaminate import find_passages
from latewise.llm.line_dedup import dedup_lines
from latewise.llm.quality import fit_ratio, fit_threshold, score_quality
from latewise.llm.registered.bpe import round_trip
from latewise.llm.registry import table
from latewise.llm.simhash import near_duplicates
from latewise.llm.work import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels, texts = table(spark, sf_dir, "labels"), docs.select("doc_id", "text")
    ratio = fit_ratio(texts, labels, hold_out=True)
    return score_quality(docs, ratio, fit_threshold(texts, labels, ratio)).filter("kept").select("record.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = dedup_lines(docs, threshold=2, min_chars=16, equal_chars=1)
    cells = {**{c: F.col("record").getField(c) for c in names}, "text": F.col("kept_text"),
             "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(cells[c].alias(c) for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: its smallest id; of rows with that id the smallest text hash."""
    keyed = docs.withColumn("_content", F.xxhash64("text"))
    near = written(near_duplicates(
        keyed.select(F.struct("doc_id", "_content").alias("key"), "text"), 4, 4, "key", "text"
    ).select("id.doc_id", F.col("id._content").alias("content"), (F.col("id") == F.col("component_id")).alias("first")))
    # The lists are far shorter than the table, so the texts of most documents need not move.
    gone = written(near.filter("not first").select(F.col("doc_id").alias("id"), "content").distinct())
    again = written(near.filter("first").groupBy(F.col("doc_id").alias("id"), "content").count().filter("count > 1"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_content") == F.col("content"))
    left = keyed.join(gone, same, "left_anti")
    once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "_content"])
    return left.join(again, same, "left_anti").unionByName(once).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_passages(docs, table(spark, sf_dir, "benchmark"), width=10)
    hit = written(found.filter(F.size("spans") > 0).select("id", "content").distinct())
    keyed = docs.withColumn("_content", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_content") == F.col("content"))
    return keyed.join(hit, same, "left_anti").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", decontamination), ("byte-level bpe", byte_bpe),
]

#: Hashes of n-grams, words and lines and the merges of the last stage are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
