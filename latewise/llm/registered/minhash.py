from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.llm.minhash import near_duplicates
from latewise.llm.registry import query, table

SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, list_distinct([array_to_string(w[k : k + 4], ' ') FOR k IN generate_series(1, greatest(1, len(w) - 4))]) AS g
  FROM w WHERE len(w) > 0),
groups AS (SELECT list_sort(g) AS g, min(doc_id) AS rep, len(any_value(g)) AS n FROM grams GROUP BY 1),
long AS (SELECT rep, n, unnest(g) AS s FROM groups),
links AS (
  SELECT a.rep AS u, b.rep AS v FROM long a JOIN long b ON a.s = b.s AND a.rep < b.rep
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT u, u AS v FROM both_ways UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON r.v = e.u),
roots AS (SELECT u, min(v) AS root FROM reach GROUP BY 1),
named AS (SELECT g, n, coalesce(root, rep) AS component_id FROM groups LEFT JOIN roots ON u = rep)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
  w.doc_id = coalesce(component_id, w.doc_id) AS kept
FROM w LEFT JOIN grams USING (doc_id) LEFT JOIN named ON list_sort(grams.g) = named.g
"""


@query("op11_minhash", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set of 5-word shingles and its component at a similarity of 0.85."""
    near = near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=85)
    return near.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
