from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latewise.llm.prefix_trie import grafted, numbered, prefix_trie
from latewise.llm.registry import query, table

# CRC-32 of the decimal id, byte by byte and bit by bit.
_CRC = """xor(list_reduce(
  list_prepend(4294967295::BIGINT, [ascii(d)::BIGINT FOR d IN regexp_extract_all(CAST(conv_id AS VARCHAR), '.')]),
  LAMBDA c, y: list_reduce(list_prepend(xor(c, y), range(8)), LAMBDA v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

SQL = f"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM placed GROUP BY 1),
planned AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM sizes),
plan AS (SELECT p.*, least(h, coalesce(s.n, 0)) AS taken FROM planned p LEFT JOIN sizes s ON s.conv_id = p.base),
rebuilt AS (
  SELECT p.conv_id, t.place, t.role, t.text FROM plan p JOIN placed t ON t.conv_id = p.base AND t.place <= p.taken
  UNION ALL
  SELECT conv_id, t.place - h + taken, role, text FROM plan JOIN placed t USING (conv_id) WHERE t.place > h),
paths AS (
  SELECT conv_id, place AS depth, length(text) AS chars,
    flatten(list([role, text]) OVER (PARTITION BY conv_id ORDER BY place)) AS path FROM rebuilt),
rows AS (SELECT conv_id, depth, chars, path FROM paths UNION ALL SELECT conv_id, 0, 0, [] FROM sizes),
longest AS (SELECT conv_id, max(depth) AS m FROM rows GROUP BY 1),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = m), '')) AS ends_sha256
  FROM rows JOIN longest USING (conv_id) GROUP BY path),
children AS (SELECT path[1:len(path) - 2] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
up AS (
  SELECT path[1:2 * k] AS path, own, n_children FROM (
    SELECT path, own, n_children, unnest(generate_series(0, depth)) AS k FROM full_nodes)),
sums AS (SELECT path, CAST(sum(own) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums ON sums.path = f.path LEFT JOIN nodes p ON f.depth > 0 AND p.path = f.path[1:len(f.path) - 2]
"""


@query("op12_prefix_trie", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, rebuilt so that conversations of one hundred share their beginnings."""
    convs, turns = grafted(numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return prefix_trie(convs, turns)
