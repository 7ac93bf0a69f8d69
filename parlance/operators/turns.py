"""Turn expansion: a row for each assistant turn to learn from, with the history before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand_turns(turns: DataFrame, policy: str = "all") -> DataFrame:
    """turns (conv_id, turn, role, text) to one row per supervised assistant turn.

    policy 'all' keeps every assistant turn, 'final_only' the last. prompt holds all earlier messages;
    the first turn of a conversation has none (null). One exchange on conv_id serves all windows.
    """
    if policy not in ("all", "final_only"):
        raise ValueError(f"unknown policy {policy!r}")
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    before = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    spoken = F.when(F.col("role") == "assistant", 1).otherwise(0)
    history = F.collect_list(F.struct("role", "text")).over(before)
    out = turns.select(
        "conv_id", "turn", "role", F.col("text").alias("completion"),
        F.when(F.size(history) > 0, history).alias("prompt"),
        F.sum(spoken).over(by_turn).cast("long").alias("assistant_turn_index"),
        F.sum(spoken).over(whole).cast("long").alias("assistant_turn_count"),
    ).where("role = 'assistant'").drop("role")
    return out.where("assistant_turn_index = assistant_turn_count") if policy == "final_only" else out
