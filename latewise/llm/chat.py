"""Chat formatting: one training string for each conversation, with the spans that carry loss.

Turn structs of a conversation are collected and sorted by (turn, role, text); neighbours of one role become one
block; blocks are concatenated with markers. Everything is a Spark expression.

A block is ``<|turn|>role<|says|>text<|next|>text...<|done|>`` and a line feed; ``<|next|>`` stands where two turns of
one role were merged, so every turn can be read back. In roles and texts ``&``, ``<`` and ``[`` are written as
entities, so no control string of this or of the bracket templates can occur there, and unescaping restores them.

Null roles and texts count as empty, a null conversation id is a conversation of its own, repeated rows stay
repeated turns, an empty table gives no rows; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, NEXT, DONE = "<|turn|>", "<|says|>", "<|next|>", "<|done|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escape(col: Column) -> Column:
    for plain, entity in ESCAPES:
        col = F.replace(col, F.lit(plain), F.lit(entity))
    return col


def unescape(col: Column) -> Column:
    for plain, entity in reversed(ESCAPES):
        col = F.replace(col, F.lit(entity), F.lit(plain))
    return col


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """(conv, blocks, formatted, loss_spans): spans are code points of ``formatted``, end exclusive, one for each
    text of ``loss_role`` in order, without markers."""
    said = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    chats = (
        turns.select(F.col(conv).alias("conv"), said.alias("said"))
        .groupBy("conv").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    )
    begins = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i).role != F.get("turns", F.greatest(i - 1, F.lit(0))).role),
    )
    chats = chats.withColumn("begins", begins)
    block = F.transform("begins", lambda at, k: F.struct(
        F.get("turns", at).role.alias("role"),
        F.transform(
            F.slice("turns", at + 1, F.coalesce(F.get("begins", k + 1), F.size("turns")) - at), lambda t: t.text
        ).alias("texts"),
    ))
    chats = chats.select("conv", block.alias("blocks"))
    no = F.lit(False)
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(_piece(F.concat(F.lit(TURN), escape(b.role), F.lit(SAYS)), no)),
        F.flatten(F.transform(b.texts, lambda t, j: F.when(
            j == 0, F.array(_piece(escape(t), b.role == loss_role))
        ).otherwise(F.array(_piece(F.lit(NEXT), no), _piece(escape(t), b.role == loss_role))))),
        F.array(_piece(F.lit(DONE), no)),
    )))
    chats = chats.withColumn("pieces", pieces)
    zero = F.lit(0).cast("long")
    spans = F.aggregate(
        "pieces",
        F.struct(zero.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc.at + F.length(p.text)).alias("at"),
            F.when(p.loss, F.concat(acc.spans, F.array(F.struct(
                acc.at.alias("start"), (acc.at + F.length(p.text)).alias("end")
            )))).otherwise(acc.spans).alias("spans"),
        ),
        lambda acc: acc.spans,
    )
    formatted = F.array_join(F.transform("pieces", lambda p: p.text), "")
    return chats.select(
        F.col("conv").alias(conv), "blocks", formatted.alias("formatted"), spans.alias("loss_spans")
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, in order."""
    blocks = F.filter(F.split(formatted, F.lit(r"<\|done\|>\n"), F.lit(-1)), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: _read_block(F.split(b, F.lit(r"<\|says\|>"), F.lit(2)))))


def _read_block(halves: Column) -> Column:
    role = unescape(F.substring(halves[0], len(TURN) + 1, 2**31 - 1))
    return F.transform(F.split(halves[1], F.lit(r"<\|next\|>"), F.lit(-1)), lambda t: F.struct(
        role.alias("role"), unescape(t).alias("text")
    ))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int"))
    )), "")
