from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.llm.registry import query, table
from latewise.llm.warc import assemble, read_warc, write_warc
from latewise.llm.work import written
from latewise.session import work_dir

SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query("op6_warc", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, read back and assembled; a revisit's payload is that of the response it refers to."""
    path = work_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    captures = written(assemble(written(read_warc(spark, path, payloads=False))).select(
        "capture_id", F.try_element_at("metadata.fields", F.lit("page-id")).cast("long").alias("page_id"),
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
    ))
    full = captures.filter(F.col("record_type") == "response").select(
        F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"),
    )
    revisit = F.col("record_type") == "revisit"
    return captures.join(full, "target", "left").select(
        "page_id", F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("full_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )
