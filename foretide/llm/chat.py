"""Preference formatting of chosen and rejected conversations; DataFrame functions only.

The turns of both sides are gathered per pair in one shuffle, the longest common prefix of turns (equal role and
text) is rendered once as the prompt, and the rest of each side is a completion. The loss mask of a completion is a
list of spans of characters (start, end exclusive) that assistants wrote.

Rows: a null role or text counts as empty; turns sort by turn, then role, then text, nulls first, so ties and repeated
rows keep a fixed order; rows without a conversation id are ignored; a pair with one side only has that side's turns as
its completion, an empty prompt and a null other side. Empty tables give no rows; extra columns are ignored. One pair's
turns meet in one row, as the formatted sample does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """start:end of each assistant text in the rendered turns, comma-joined."""
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["role"]) + F.length(t["text"]) + F.lit(len(OPEN) + len(CLOSE) + 1)).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.array_append(a["spans"], F.concat((a["at"] + F.length(t["role"]) + F.lit(len(OPEN) + len(CLOSE))).cast("string"), F.lit(":"), (a["at"] + F.length(t["role"]) + F.length(t["text"]) + F.lit(len(OPEN) + len(CLOSE))).cast("string"))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return F.array_join(step["spans"], ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """turns (pair_id, side 'chosen' or 'rejected', turn, role, text) -> one row per pair."""
    t = turns.where(F.col("pair_id").isNotNull()).select("pair_id", "side", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sides = t.groupBy("pair_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(s) for s in ("chosen", "rejected")))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    n = F.when(differs > 0, differs - 1).otherwise(F.size("chosen")).cast("int")
    p = sides.withColumn("n_common", n)
    rest = {s: F.slice(s, F.col("n_common") + 1, F.greatest(F.size(s) - F.col("n_common"), F.lit(0))) for s in ("chosen", "rejected")}
    return p.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        _render(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        *(F.when(F.size(s) > 0, _render(rest[s])).alias(s) for s in ("chosen", "rejected")),
        *(F.when(F.size(s) > 0, _mask(rest[s])).alias(f"{s}_mask") for s in ("chosen", "rejected")),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k+1 as the chosen and the rejected side of pair k."""
    c = F.col("conv_id")
    return conversations.where(c.isNotNull()).select(F.floor(c / 2).cast("long").alias("pair_id"), F.when(F.pmod(c, F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")
