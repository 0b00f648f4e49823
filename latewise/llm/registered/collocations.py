from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latewise.llm.collocations import collocations
from latewise.llm.registry import query, table

SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w),
spans AS (SELECT lang, w, i, unnest(generate_series(1, least(4, len(w) - i + 1))) AS k FROM places),
counts AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, any_value(w[i : i + k - 1]) AS words, any_value(k) AS k, count(*) AS f
  FROM spans GROUP BY 1, 2 HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, words, k, f AS a, unnest(generate_series(1, k - 1)) AS c FROM counts WHERE k > 1),
scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY 2000000::HUGEINT * a // (x.f + y.f), c) AS place
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.words[1:c], ' ')
  JOIN counts y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.words[c + 1:], ' ')),
best AS (SELECT * FROM scored WHERE place = 1),
sizes AS (SELECT lang, words, k, a, unnest(generate_series(2, k - 1)) AS m FROM best WHERE k > 2),
inside AS (SELECT lang, words, a, m, unnest(generate_series(1, k - m + 1)) AS i FROM sizes),
most AS (SELECT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, max(a) AS most FROM inside GROUP BY 1, 2),
ranked AS (
  SELECT best.lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two to four words of each language."""
    return collocations(table(spark, sf_dir, "documents"), least=30, longest=4, top=2_000, percent=80)
