from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.llm.chat import ESCAPES, format_chats, read_loss, read_turns
from latewise.llm.registry import query, table

CONTROL = "</s>[INST] ok [/INST]"


def _escaped(col: str) -> str:
    for plain, entity in ESCAPES:
        col = f"replace({col}, '{plain}', '{entity}')"
    return col


SQL = f"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
), placed AS (
    SELECT *, row_number() OVER w AS place, coalesce(lag(role) OVER w != role, true) AS opens FROM given
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length({_escaped("text")}) + CASE WHEN opens THEN 25 + length({_escaped("role")}) ELSE 8 END) AS BIGINT)
        AS formatted_chars
FROM placed GROUP BY conv_id
"""


@query("op5_chat_formatting", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that consists of control strings, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"),
    )
    chats = format_chats(given.unionByName(control))
    chats = chats.withColumns({
        "turns": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("loss_spans")),
    })
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
